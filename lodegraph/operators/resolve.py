"""Lookup indexes and resolution of names, identifiers, masses and spectra, with abstention."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.keys import folded_key, id_token
from lodegraph.operators.ordering import first_in_group, top_in_group
from lodegraph.runtime import BROADCAST_ROWS, Scratch, fresh, task_count

# What a namespace is also called.
NAMESPACE_ALIASES = {"PUBCHEM.COMPOUND": ("CID", "PUBCHEM"), "NCBI.GENE": ("ENTREZ",)}


class LookupSpec(NamedTuple):
    """A field of an entity table that can be looked up."""

    entity: str  # the column of the entity's uid
    kind: str
    field: str
    namespace: str  # TEXT for names
    rank: int


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few enough rows (they are counted)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lookup_index(df: DataFrame, specs: Sequence[LookupSpec]) -> DataFrame:
    """entity_uid, entity_type, namespace, lookup_key, raw_value, match_field, rank.

    Fields may be strings or lists; blank values give no row; a namespace is
    also indexed under its aliases.  Equal rows are kept once, by best rank.
    """
    types = dict(df.dtypes)
    parts = []
    for s in specs:
        raw = F.explode(s.field) if types[s.field].startswith("array") else F.col(s.field).cast("string")
        spaces = F.explode(F.array(*[F.lit(n) for n in (s.namespace, *NAMESPACE_ALIASES.get(s.namespace, ()))]))
        part = df.select(F.col(s.entity).alias("entity_uid"), raw.alias("raw_value")).withColumn("namespace", spaces)
        key = folded_key(F.col("raw_value")) if s.namespace == "TEXT" else id_token(F.col("raw_value"))
        parts.append(part.withColumn("lookup_key", key).withColumn("entity_type", F.lit(s.kind)).withColumn("match_field", F.lit(s.field)).withColumn("rank", F.lit(s.rank)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.filter("entity_uid is not null and lookup_key <> ''")
    keys = ["entity_uid", "entity_type", "namespace", "lookup_key", "match_field"]
    return out.groupBy(*keys).agg(F.max("rank").alias("rank"), F.min("raw_value").alias("raw_value"))


def expand_queries(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, namespace, lookup_key, priority: the lookups that a typed text stands for.

    An InChIKey, a number and a `SOURCE:id` are looked up as identifiers first
    (priorities 120, 60 and 100), every text as a name (10).
    """
    t = F.trim(F.col(text))
    one = lambda when, space, k, p: F.when(when, F.struct(space.alias("namespace"), k.alias("lookup_key"), F.lit(p).alias("priority")))
    prefix = F.upper(F.regexp_extract(t, "^([A-Za-z.]+):", 1))
    asks = F.array_compact(
        F.array(
            one(t.rlike("^[A-Z]{14}-[A-Z]{10}-[A-Z]$"), F.lit("INCHIKEY"), F.lower(t), 120),
            one((prefix != "") & t.rlike("^[A-Za-z.]+:[^ ]+$"), prefix, id_token(t), 100),
            one(t.rlike("^[0-9]+$"), F.lit("CID"), t, 60),
            one(t != "", F.lit("TEXT"), folded_key(t), 10),
        )
    )
    return df.select(F.col(key), F.inline(asks))


def resolve(queries: DataFrame, key: str, index: DataFrame, most: int = 10) -> DataFrame:
    """key, place, entity_uid, entity_type, raw_value, score: the best entities of each query, best first.

    Priority decides, then rank, then type, uid and raw value.
    """
    hits = queries.join(index, ["namespace", "lookup_key"])
    hits = hits.select(key, "entity_uid", "entity_type", "raw_value", "priority", "rank", (-F.col("priority")).alias("p"), (-F.col("rank")).alias("r"))
    best = first_in_group(hits, [key, "entity_uid"], ["p", "r", "entity_type", "raw_value"])
    order = [F.asc("p"), F.asc("r"), F.asc("entity_type"), F.asc("entity_uid"), F.asc("raw_value")]
    return top_in_group(best, [key], order, most, "place").select(key, "place", "entity_uid", "entity_type", "raw_value", (F.col("priority") + F.col("rank")).alias("score"))


def settle(candidates: DataFrame, key: str, uid: str, score: str, least: float, margin: float) -> DataFrame:
    """key, status, uid, top, second, n_uids: `matched` only with a clear winner.

    ambiguous: the best score is below `least` or less than `margin` above the
    second; a matched row names its uid, others don't.
    """
    best = candidates.groupBy(key, uid).agg(F.max(score).alias("s"))
    # the two best scores of a key without a window over all of its rows
    two = best.groupBy(key).agg(F.max(F.struct("s", uid)).alias("w"), F.count("*").alias("n_uids"))
    rest = best.join(two.select(key, F.col(f"w.{uid}").alias("_won")), key).filter(F.col(uid) != F.col("_won")).groupBy(key).agg(F.max("s").alias("second"))
    out = two.join(rest, key, "left").select(key, F.col(f"w.{uid}").alias("_uid"), F.col("w.s").alias("top"), "second", "n_uids")
    clear = (F.col("top") >= least) & (F.col("second").isNull() | (F.col("top") - F.col("second") >= margin))
    return out.select(key, F.when(clear, "matched").otherwise("ambiguous").alias("status"), F.when(clear, F.col("_uid")).alias(uid), "top", "second", "n_uids")


def precheck(records: DataFrame, key: str, text: str, settled: DataFrame) -> DataFrame:
    """key, bucket: matched, ambiguous, unmatched, or invalid for records without a usable text."""
    joined = records.select(key, F.trim(text).alias("_t")).join(settled.select(key, "status"), key, "left")
    invalid = F.col("_t").isNull() | (F.length("_t") < 2)
    return joined.select(key, F.when(invalid, "invalid").when(F.col("status").isNull(), "unmatched").otherwise(F.col("status")).alias("bucket"))


def tolerance_join(left: DataFrame, x: str, right: DataFrame, y: str, width: Column, bucket: float) -> DataFrame:
    """Pairs with |x - y| <= width; rows of the left side are looked up in the buckets that their window touches.

    An equi-join on buckets of fixed size with the exact test after it: no range
    join and no cross join. `bucket` should be near the usual width.
    """
    low, high = F.floor((F.col(x) - width) / bucket), F.floor((F.col(x) + width) / bucket)
    asks = left.filter(F.col(x).isNotNull()).withColumn("_w", width).withColumn("_b", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    held = right.filter(F.col(y).isNotNull()).withColumn("_b", F.floor(F.col(y) / bucket).cast("long"))
    return asks.join(held, "_b").filter(F.abs(F.col(x) - F.col(y)) <= F.col("_w")).drop("_b", "_w")


def value_join(left: DataFrame, x: str, right: DataFrame, y: str, width: float, pairs_per_task: int = 20_000_000) -> DataFrame:
    """Pairs with |x - y| <= width, where many rows share a value.

    The distinct values are matched first, with their counts, so that no pair of
    rows is tested that isn't one of the result.  The counts give the number of
    tasks (the rows' bytes don't show how many pairs they make), and a value with
    more pairs than a task should make is divided: its left rows by a hash, its
    right rows repeated.
    """
    spark = left.sparkSession
    scratch = Scratch(spark, "values")
    n, m, pairs, parts, part = fresh(left.join(right), "_n", "_m", "_pairs", "_parts", "_part")
    asked = left.groupBy(x).agg(F.count("*").alias(n))
    held = right.groupBy(y).agg(F.count("*").alias(m))
    near = scratch.save(tolerance_join(asked, x, held, y, F.lit(width), width * 2))
    load = near.groupBy(y).agg((F.sum(n) * F.first(m)).alias(pairs))
    load = scratch.save(load.select(y, pairs, F.ceil(F.col(pairs) / pairs_per_task).cast("int").alias(parts)))
    tasks = task_count(spark, load.agg(F.sum(pairs)).head()[0] or 0, pairs_per_task)
    asks = left.join(near.select(x, y), x).join(load.select(y, parts), y).withColumn(part, F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop(parts)
    gives = right.join(load.select(y, parts), y).withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return asks.repartition(tasks, y, part).join(gives.repartition(tasks, y, part), [y, part]).select(*left.columns, *right.columns)


def spectrum_scores(queries: DataFrame, library: DataFrame, tolerance: float = 0.01, most: int | None = None) -> DataFrame:
    """query, entry, n_shared, cosine: peaks matched within a tolerance; only the `most` best entries of a query, if given (ties by entry).

    queries: query, mz, intensity; library: entry, mz, intensity.  A query peak
    takes the nearest peak of an entry, and the cosine is over square roots of
    intensities.
    """
    q = queries.select("query", F.col("mz").alias("q_mz"), F.sqrt("intensity").alias("a"))
    e = library.select("entry", F.col("mz").alias("e_mz"), F.sqrt("intensity").alias("b"))
    pairs = tolerance_join(q, "q_mz", e, "e_mz", F.lit(tolerance), tolerance * 2)
    near = pairs.groupBy("query", "entry", "q_mz", "a").agg(F.min(F.struct(F.abs(F.col("q_mz") - F.col("e_mz")), "e_mz", "b"))["b"].alias("b"))
    dot = near.groupBy("query", "entry").agg(F.count("*").alias("n_shared"), F.sum(F.col("a") * F.col("b")).alias("dot"))
    na = q.groupBy("query").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"))
    nb = e.groupBy("entry").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    out = dot.join(na, "query").join(nb, "entry").select("query", "entry", "n_shared", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))
    return out if most is None else top_in_group(out, ["query"], [F.desc(F.round("cosine", 9)), F.asc("entry")], most)


def first_key_hit(rows: DataFrame, key: str, keys: str, index: DataFrame) -> DataFrame:
    """key, uid, place: each row's list of keys is tried in order against index (lookup_key, uid); the first hit wins."""
    tried = rows.select(key, F.posexplode(keys).alias("place", "lookup_key"))
    hits = tried.join(index.groupBy("lookup_key").agg(F.min("uid").alias("uid")), "lookup_key")
    return hits.groupBy(key).agg(F.min(F.struct("place", "uid")).alias("h")).select(key, "h.uid", "h.place")


# Names that need an isomer or a stereo form to be one compound, and names that are too broad.
ISOMER_NAMES = (
    "aconitate", "2-hydroxyglutarate", "2 hydroxyglutarate", "xanthine", "sorbitol", "butyrylcarnitine", "free carnitine", "asymmetric dimethylarginine",
)
BROAD_NAMES = ("acid", "base", "salt", "unknown", "lipid", "ceramide", "hexose", "pentose", "sugar", "protein", "peptide")
# Fixed pattern: shorthand of lipid chains.
LIPID_SHORTHAND = r"(?i)(?:\b(?:[a-z]{1,4}\s*)?\d{1,2}:\d(?:/\d{1,2}:\d)?\b|ceramide\s+d\d{1,2}:\d/\d{1,2}:\d|d\d{1,2}:\d/\d{1,2}:\d)"
# Points of the reasons.
RISK_POINTS = {
    "name_maps_to_multiple_metabolites": 35, "stereo_or_isomer_under_specified": 35, "lipid_shorthand_or_chain_notation": 30, "delimiter_sensitive_name": 20,
    "broad_or_short_surface": 20, "synonym_only_low_rank_surface": 10,
}


def name_risk(index: DataFrame, name: str, uid: str, raw: str, field: str, rank: str, authority: str | None = None) -> DataFrame:
    """name, n_uids, risk_reasons (list), risk_score, action, policy of every name of an index.

    raw: the spelling (the smallest one stands for the name); field: a name that no
    canonical_name has and that ranks 70 or lower is a synonym only.  More than two
    uids add 3 points each, at most 30; a name without an authority adds 15, if a
    column (boolean) says which have one.  A name without a reason has an empty
    list, and its action is `review`.
    """
    named = index.filter(F.col(name).isNotNull())
    known = F.coalesce(F.bool_or(F.col(authority)), F.lit(False)) if authority else F.lit(True)
    per = named.groupBy(name).agg(
        F.count_distinct(uid).alias("n_uids"), F.min(raw).alias("_raw"), F.coalesce(F.bool_or(F.col(field) == "canonical_name"), F.lit(False)).alias("_canonical"), F.min(rank).alias("_rank"), known.alias("_known")
    )
    compact = F.replace(F.regexp_replace(F.col(name), "[\u2010-\u2015]", "-"), F.lit("-"), F.lit(" "))
    said = (
        ("name_maps_to_multiple_metabolites", F.col("n_uids") > 1),
        ("delimiter_sensitive_name", F.col("_raw").contains(",")),
        ("lipid_shorthand_or_chain_notation", F.col("_raw").rlike(LIPID_SHORTHAND)),
        ("stereo_or_isomer_under_specified", compact.isin(*ISOMER_NAMES)),
        ("broad_or_short_surface", compact.isin(*BROAD_NAMES) | (F.length(F.regexp_replace(compact, "[^a-z0-9]", "")) <= 3)),
        ("synonym_only_low_rank_surface", ~F.col("_canonical") & (F.coalesce("_rank", F.lit(0)) <= 70)),
    )
    out = per.withColumn("risk_reasons", F.array_compact(F.array(*[F.when(c, r) for r, c in said])))
    has = lambda r: F.array_contains("risk_reasons", r)
    points = sum((F.when(has(r), n).otherwise(0) for r, n in RISK_POINTS.items()), F.lit(0))
    extra = F.when(F.col("n_uids") > 2, F.least(F.lit(30).cast("long"), 3 * F.col("n_uids"))).otherwise(0) + F.when(F.col("_known"), 0).otherwise(15)
    out = out.withColumn("risk_score", (points + extra).cast("long"))
    several, lipid = has("name_maps_to_multiple_metabolites"), has("lipid_shorthand_or_chain_notation")
    action = (
        F.when(has("stereo_or_isomer_under_specified"), "require_specific_isomer_or_identifier").when(several & lipid, "require_lipid_identifier").when(several, "manual_review_required")
        .when(has("delimiter_sensitive_name"), "quote_delimiter_sensitive_name").when(lipid, "prefer_lipid_identifier").when(has("broad_or_short_surface"), "avoid_broad_surface").otherwise("review")
    )
    strict = ("require_specific_isomer_or_identifier", "require_lipid_identifier", "manual_review_required", "avoid_broad_surface")
    policy = (
        F.when(F.col("action").isin(*strict), "auto_abstain_name_only").when(lipid, "requires_identifier_or_orthogonal_feature").when(F.col("action") == "quote_delimiter_sensitive_name", "format_warning")
        .when(F.col("risk_score") >= 70, "auto_abstain_name_only").when(F.col("risk_score") >= 35, "monitor_or_downweight").otherwise("monitor")
    )
    return out.withColumn("action", action).withColumn("policy", policy).drop("_raw", "_canonical", "_rank", "_known")


def expand_seeds(candidates: DataFrame, record: str, uid: str, kind: str) -> DataFrame:
    """record, uid, seed_weight: unsure records keep a small weight that their candidates share.

    Weight by kind: matched 1, soft .50, analog .30, ratio .25, class .20.
    """
    weight = F.when(F.col(kind) == "matched", 1.0).when(F.col(kind) == "soft", 0.5).when(F.col(kind) == "analog", 0.3).when(F.col(kind) == "ratio", 0.25).when(F.col(kind) == "class", 0.2).otherwise(0.0)
    shared = candidates.select(record, uid, weight.alias("w")).distinct()
    counted = shared.groupBy(record).agg(F.count_distinct(uid).alias("n"))
    return shared.join(counted, record).select(record, uid, (F.col("w") / F.col("n")).alias("seed_weight"))
