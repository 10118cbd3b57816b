"""Judge URLs by host rules and by a weighted vocabulary.

A rule names a host and a path start; it fits the host and all its subdomains. The longest rule that
fits decides. Other URLs are scanned once by an Aho-Corasick automaton over all terms: a term counts
where no letter or digit stands next to it; one strict term, or several distinct soft terms, block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Rules (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# Terms of which one is enough.
STRICT = (
    "porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "milf", "camgirl", "camgirls", "livesex",
    "sexcam", "sexcams", "escort", "escorts", "casino", "casinos", "blackjack", "roulette", "sportsbook",
    "viagra", "cialis", "phentermine", "pills", "spam", "ads-track", "adserver", "doubleclick", "warez",
    "keygen", "torrent", "torrents", "cracked", "phishing", "malware",
)
# Terms of which several distinct ones are needed.
SOFT = (
    "adult", "x", "sex", "sexy", "nude", "naked", "erotic", "dating", "hot", "girls", "webcam", "bet", "bets",
    "betting", "poker", "slots", "jackpot", "win", "bonus", "free", "cheap", "discount", "deal", "deals",
    "coupon", "promo", "replica", "pharmacy", "rx", "pill", "loan", "loans", "payday", "credit", "crypto",
    "forex", "farm", "ads", "track", "tracker", "click", "popup", "banner", "download", "crack", "serial",
)
SOFT_NEEDED = 2


def _lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_LOWER)


_LOWER = {code: code + 32 for code in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (lower-cased A-Z) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for stop in "?#":
        rest = rest.split(stop, 1)[0]
    host, slash, path = rest.partition("/")
    return _lower(host), slash + path


def rule_table(rules: Iterable[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """Host to its (path, rule, verdict), longest rule first."""
    found: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        found.setdefault(_lower(host), []).append((slash + path, rule, verdict))
    return {h: sorted(rows, key=lambda r: (-len(r[0]), r[1])) for h, rows in found.items()}


def fitting_rule(host: str, path: str, table: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits: hosts from the full name down to the last label."""
    best = None
    labels = host
    while labels:
        for start, rule, verdict in table.get(labels, ()):
            if path.startswith(start):
                if best is None or len(rule) > len(best[0]):
                    best = rule, verdict
                break
        labels = labels.partition(".")[2]
    return best


def automaton(strict: Iterable[str], soft: Iterable[str]) -> ahocorasick.Automaton:
    """All terms with their kind; a term in both lists is strict."""
    terms = {_lower(t): False for t in soft} | {_lower(t): True for t in strict}
    machine = ahocorasick.Automaton()
    for term, is_strict in terms.items():
        machine.add_word(term, (term, is_strict))
    machine.make_automaton()
    return machine


def count_terms(url: str | None, machine: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict terms of the whole URL and distinct soft terms of its host and path, where no
    letter or digit of ASCII stands next to them."""
    if not url or not len(machine):
        return 0, 0
    text = _lower(url)
    found = set()
    first = text.find("://") + 3 if "://" in text else 0
    stop = min([at for at in (text.find("?", first), text.find("#", first)) if at >= 0], default=len(text))
    for end, (term, is_strict) in machine.iter(text):
        start = end - len(term) + 1
        if not is_strict and (start < first or end >= stop):
            continue
        if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            found.add((term, is_strict))
    strict = sum(is_strict for _, is_strict in found)
    return strict, len(found) - strict


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_needed: int = SOFT_NEEDED,
) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule (null where none fits), verdict, n_strict,
    n_soft.

    A null or relative URL has an empty host and path and no rule; its terms count as for any other.
    Repeated rows give repeated rows, an empty table none; other columns are not read. Nothing is
    shuffled: rules and terms travel with the task.
    """
    kind = pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, machine = rule_table(rules), automaton(strict, soft)
        for batch in batches:
            rows = []
            for address in batch.column(1).to_pylist():
                host, path = split_url(address)
                rule, verdict = fitting_rule(host, path, table) or (None, None)
                n_strict, n_soft = count_terms(address, machine)
                if verdict is None:
                    verdict = "block" if n_strict or n_soft >= soft_needed else "allow"
                rows.append((host, path, rule, verdict, n_strict, n_soft))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.string()] * 4 + [pa.int32()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=[key, "host", "path", "rule", "verdict", "n_strict", "n_soft"]
            )

    schema = f"`{key}` {kind}, host string, path string, rule string, verdict string, n_strict int, n_soft int"
    return pages.select(key, url).mapInArrow(judge, schema)
