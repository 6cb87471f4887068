"""SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_MISSING = "(trim({x}, ' ') = '' or not regexp_matches({x}, '[\\p{{L}}\\p{{N}}]') or lower(trim({x}, ' ')) in ({words}))"
_WORDS = ", ".join(
    f"'{w}'"
    for w in (
        "n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "unknown", "unk", "tbd", "tba", "missing", "pending", "not available", "not provided",
        "not assigned", "not known", "not given", "not applicable", "not specified", "description pending", "name pending", "no description available",
        "no description", "to be annotated", "see source record", "uncharacterized", "uncharacterised", "undefined", "unspecified", "unnamed",
        "#n/a", "#ref!", "#name?", "#value!", "#div/0!", "#null!", "#num!",
    )
)
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
_SHEET = rf"^(\d{{1,4}}[-/ ]{_MONTH}([-/ ]\d{{2,4}})?|{_MONTH}[-/ ]\d{{1,4}}|\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}|\d+(\.\d+)?e[+-]?\d+|\d+(\.\d+)?)$"
_CUT = r"(…|\.\.+|[\[(<{](\.\.\.?|…|truncated|cut( off)?|cont(inued|\.)?|more)[\])>}]?\.?)\s*$"


def _usable(x: str) -> str:
    missing = _MISSING.format(x=x, words=_WORDS)
    return f"({x} is not null and not {missing} and not regexp_matches(lower(trim({x}, ' ')), '{_SHEET}') and not regexp_matches(lower({x}), '{_CUT}'))"


def _won(field: str, ahead: str = "") -> str:
    return f"arg_min(record_id, ({ahead}tier, -coalesce(epoch(updated_at), -1e18), record_id)) filter ({_usable(field)})"


_IDENTIFIER = r"""
    x as (select distinct chemical_uid as r, upper(regexp_replace(xref_source, '\s', '', 'g')) as s, upper(regexp_replace(xref_id, '\s', '', 'g')) as i, xref_id from chemical_xrefs where xref_type = 'exact'),
    n as (select r, s, xref_id, regexp_replace(regexp_replace(case when starts_with(i, s) then regexp_replace(i, '^(' || s || '[:_#-]*)+', '') else i end, '^([0-9]+)\.0+$', '\1'), '^([A-Z]*)0+([0-9])', '\1\2') as b from x),
    l as (select distinct r, s || ':' || b as i from n where xref_id is not null and s <> '' and not regexp_full_match(b, '0*')
          and not """ + _MISSING.format(x="xref_id", words=_WORDS) + ")"

ORACLES = {
    "p2_found": f"""
        with g as (select distinct record_id, gene_uid, symbol, description, aliases, source_name, updated_at from genes where gene_uid is not null),
        a as (select record_id, count(distinct lower(trim(x, ' '))) as n from (select record_id, unnest(aliases) as x from g) where {_usable("x")} group by 1),
        t as (select g.*, coalesce(trust_rank, 1000000) as tier, coalesce(n, 0) as n from g left join source_trust using (source_name) left join a using (record_id))
        select gene_uid, coalesce({_won("symbol")}, 0)::bigint as symbol_record_id, coalesce({_won("description")}, 0)::bigint as description_record_id,
          coalesce(arg_min(record_id, (-n, tier, -coalesce(epoch(updated_at), -1e18), record_id)) filter (n > 0), 0)::bigint as aliases_record_id
        from t group by gene_uid having count(*) >= 2""",
    "p5_found": f"""
        with recursive {_IDENTIFIER}, e as (select distinct a.r as a, b.r as b from l a join l b using (i)),
        t as (select distinct r as a, r as b from l union select t.a, e.b from t join e on t.b = e.a),
        g as (select a as chemical_uid, min(b) as group_uid, count(*) as n from t group by 1)
        select chemical_uid, group_uid from g where n >= 2""",
    "p5_group_sizes": f"""
        with recursive {_IDENTIFIER}, e as (select distinct a.r as a, b.r as b from l a join l b using (i)),
        t as (select distinct r as a, r as b from l union select t.a, e.b from t join e on t.b = e.a),
        g as (select a, min(b) as group_uid, count(*) as n_records from t group by 1)
        select n_records, count(distinct group_uid) as n_groups from g group by 1""",
}
