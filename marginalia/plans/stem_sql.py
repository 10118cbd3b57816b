"""The published Snowball English rules as SQL over a relation of distinct terms."""

from __future__ import annotations

from collections.abc import Iterable

from marginalia.functions import stem

_VOWELS = "[aeiouy]"
_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _listed(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


STOP_WORDS_SQL = f"({_listed(stem.STOP_WORDS)})"


def _suffix(word: str, suffixes: Iterable[str]) -> str:
    """The longest of the suffixes that the word ends with, or an empty string."""
    ordered = sorted(suffixes, key=lambda s: (-len(s), s))
    return "case " + " ".join(f"when ends_with({word}, '{s}') then '{s}'" for s in ordered) + " else '' end"


def _cut(word: str, count: str) -> str:
    return f"substr({word}, 1, greatest(0, length({word}) - {count}))"


def _replaced(table: dict[str, str]) -> str:
    return "case s " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def stems_sql(terms: str, name: str = "stems") -> str:
    """CTEs that end with ``name`` (term, stem) for the relation ``terms`` (term)."""
    base = _cut("w", "length(s)")
    steps = [
        f"select term, term as w0, regexp_replace(term, '^y', 'Y') as w from {terms}",
        *["select * replace (regexp_replace(w, '([aeiouyY])y', '\\1Y', 'g') as w) from {before}"] * 3,
        "select *, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen)')), 0), "
        f"nullif(length(regexp_extract(w, '^.*?{_VOWELS}[^aeiouy]')), 0), length(w)) as r1 from {{before}}",
        f"select *, r1 + coalesce(nullif(length(regexp_extract(substr(w, r1 + 1), '^.*?{_VOWELS}[^aeiouy]')), 0), "
        "length(w) - r1) as r2 from {before}",
        # Plurals.
        f"""select * replace (case when ends_with(w, 'sses') then {_cut("w", "2")}
          when ends_with(w, 'ied') or ends_with(w, 'ies') then case when length(w) > 4 then {_cut("w", "2")} else {_cut("w", "1")} end
          when ends_with(w, 's') and not ends_with(w, 'us') and not ends_with(w, 'ss')
            and regexp_matches({_cut("w", "2")}, '{_VOWELS}') then {_cut("w", "1")}
          else w end as w) from {{before}}""",
        f"select *, w in ({_listed(stem._UNCHANGED_AFTER_1A)}) as stays, w as early, "
        f"{_suffix('w', ('eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'))} as s from {{before}}",
        # Past and present participles.
        f"select *, {base} as b from {{before}}",
        f"""select * exclude (s, b) replace (case when s in ('eed', 'eedly') then case when length(b) >= r1 then b || 'ee' else w end
          when s <> '' and regexp_matches(b, '{_VOWELS}') then case
            when regexp_matches(b, '(at|bl|iz)$') then b || 'e'
            when regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then {_cut("b", "1")}
            when r1 >= length(b) and regexp_matches(b, '{_SHORT}') then b || 'e' else b end
          else w end as w) from {{before}}""",
        f"""select * replace (case when length(w) > 2 and regexp_matches(w, '[^aeiouy][yY]$') then {_cut("w", "1")} || 'i' else w end as w)
          from {{before}}""",
        f"select *, {_suffix('w', (*stem._STEP2, 'ogi', 'li'))} as s from {{before}}",
        f"""select * exclude (s) replace (case when s = '' or length(w) - length(s) < r1 then w
          when s = 'ogi' then case when ends_with(w, 'logi') then {_cut("w", "1")} else w end
          when s = 'li' then case when length(w) > 2 and regexp_matches(w, '[cdeghkmnrt]li$') then {_cut("w", "2")} else w end
          else {base} || {_replaced(stem._STEP2)} end as w) from {{before}}""",
        f"select *, {_suffix('w', (*stem._STEP3, 'ative'))} as s from {{before}}",
        f"""select * exclude (s) replace (case when s = '' or length(w) - length(s) < r1 then w
          when s = 'ative' then case when length(w) - length(s) >= r2 then {base} else w end
          else {base} || {_replaced(stem._STEP3)} end as w) from {{before}}""",
        f"select *, {_suffix('w', (*stem._STEP4, 'ion'))} as s from {{before}}",
        f"""select * exclude (s) replace (case when s = '' or length(w) - length(s) < r2 then w
          when s = 'ion' then case when regexp_matches(w, '[st]ion$') then {base} else w end
          else {base} end as w) from {{before}}""",
        f"""select * replace (case when ends_with(w, 'e') then case
            when length(w) - 1 >= r2 or length(w) - 1 >= r1 and not regexp_matches({_cut("w", "1")}, '{_SHORT}') then {_cut("w", "1")}
            else w end
          when ends_with(w, 'll') and length(w) - 1 >= r2 then {_cut("w", "1")} else w end as w) from {{before}}""",
    ]
    parts, before = [], terms
    for number, step in enumerate(steps):
        parts.append(f"{name}_{number} as ({step.replace('{before}', before)})")
        before = f"{name}_{number}"
    irregular = " ".join(f"when '{k}' then '{v}'" for k, v in stem._IRREGULAR.items())
    parts.append(
        f"""{name} as (select term, case when length(term) <= 2 or term in ({_listed(stem._UNCHANGED)}) then term
          else case term {irregular} else replace(case when stays then early else w end, 'Y', 'y') end end as stem from {before})"""
    )
    return ",\n".join(parts)
