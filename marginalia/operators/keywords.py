"""Weighted full-text search over a postings table.

Postings are built row by row; texts are dealt out by chunk before, so that what is gathered per chunk
moves no postings. They are meant to be written once, clustered by term. A search joins them with the terms of the queries, gathers the occurrences per query and
chunk, and takes the cover density rank from them: the sum, over the minimal stretches that satisfy
the query, of the harmonic mean of the term weights divided by one plus the number of other words
inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import SearchDefaults
from marginalia.functions.rows import explode_array
from marginalia.functions.stem import STOP_WORDS, stem_terms
from marginalia.functions.text import word_tokens
from marginalia.operators.covers import rank_covers
from marginalia.session import cut_lineage

# Weights of title, content and contextual text.
FIELD_WEIGHTS = (("chunk_title", 1.0), ("content", 0.4), ("contextual_text", 0.2))
RANK_DIGITS = 9
_BITS = 62
_TAIL = 8
#: A vocabulary of at most so many terms, counted before, is broadcast.
MOST_BROADCAST = 500_000


def _is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def field_words(store: DataFrame, own: list, english: bool, fields: tuple[tuple[str, float], ...]) -> DataFrame:
    """The columns ``own``, the words of each field as ``_words<n>``, their number as ``_size<n>`` and, of all fields but the last,
    the place of the last word that is listed as ``_listed<n>``."""
    words = [f"_words{number}" for number in range(len(fields))]
    staged = store.select(
        *own, *[word_tokens(F.coalesce(F.col(name), F.lit(""))).alias(w) for w, (name, _) in zip(words, fields)]
    )

    def listed_to(field: str) -> Column:
        if not english:
            return F.size(field)
        last = lambda words: F.array_max(F.transform(words, lambda term, i: F.when(~_is_stop_word(term), i + 1)))
        # Nearly always one of the last words is listed; the others are looked at where none is.
        skipped = F.greatest(F.size(field) - _TAIL, F.lit(0))
        return F.coalesce(skipped + last(F.slice(F.col(field), skipped + 1, F.lit(_TAIL))), last(F.col(field)), F.lit(0))

    # Per field the place of its first word among all, and the position before it.
    return staged.withColumns(
        {f"_size{n}": F.size(w) for n, w in enumerate(words)} | {f"_listed{n}": listed_to(w) for n, w in enumerate(words[:-1])}
    )


def build_postings(
    store: DataFrame,
    english: bool = True,
    fields: tuple[tuple[str, float], ...] = FIELD_WEIGHTS,
    id_col: str = "id",
    keep: tuple[str, ...] = (),
    neighbours: bool = False,
) -> DataFrame:
    """Rows (id, term, position, weight) and the columns ``keep`` of the chunk. Positions run on from field
    to field, each from the last listed word of the one before; English stop words take a position but
    are not listed. Chunks are dealt out by id, but where columns are kept the caller has dealt them out.

    ``neighbours`` adds the words ``before`` and ``after`` (empty: none; null: not known, as in chunks whose
    id is not their own alone), with which a search finds phrases early. Not for English."""
    own = [F.col(id_col).alias("id"), *keep]
    neighbours = neighbours and not english
    words = [f"_words{number}" for number in range(len(fields))]
    if not keep:
        store = store.select(id_col, *[name for name, _ in fields if name != id_col]).repartition(id_col)
    if neighbours:
        several = store.groupBy(id_col).agg((F.count("*") > 1).alias("_several")).filter("_several")
        store = store.join(several, id_col, "left")
        own.append((F.col("_several") | F.col(id_col).isNull()).alias("_several"))
    staged = field_words(store, own, english, fields)
    if neighbours:
        staged = staged.withColumn("_all", F.concat(*words))
    kept = ["id", *keep, *(["_several", "_all"] if neighbours else []), *[f"_size{n}" for n in range(len(words))], *[f"_listed{n}" for n in range(len(words) - 1)]]
    rows = explode_array(staged, kept, F.col("_all") if neighbours else F.concat(*words), "_n", "term")
    if english:
        rows = rows.filter(~_is_stop_word(F.col("term")))
    position, weight = F.col("_n") + 1, F.lit(fields[0][1])
    begin, before = F.lit(0), F.lit(0)
    for n in range(1, len(fields)):
        begin, before = begin + F.col(f"_size{n - 1}"), before + F.col(f"_listed{n - 1}")
        position = F.when(F.col("_n") >= begin, F.col("_n") - begin + before + 1).otherwise(position)
        weight = F.when(F.col("_n") >= begin, F.lit(fields[n][1])).otherwise(weight)
    beside = []
    if neighbours:
        word = lambda place: F.coalesce(F.get("_all", place), F.lit(""))
        known = lambda place: F.when(F.col("_several"), None).otherwise(word(place))
        beside = [known(F.col("_n") - 1).alias("before"), known(F.col("_n") + 1).alias("after")]
    return rows.select("id", *keep, "term", position.cast("int").alias("position"), weight.alias("weight"), *beside)


def chunk_terms(postings: DataFrame) -> DataFrame:
    """Rows (id, term, occurrences, weight, positions): the postings of a term in a chunk, added up."""
    return postings.groupBy("id", "term").agg(
        F.count("*").alias("occurrences"), F.sum("weight").alias("weight"), F.sum("position").alias("positions")
    )


def term_counts(postings: DataFrame) -> DataFrame:
    """Rows (term, occurrences, chunks, weight, positions). Each chunk is counted once, before the shuffle
    by term: in postings with a column ``block``, the id without its six low bits, as a bit of its block."""
    if "block" in postings.columns:
        in_block = postings.groupBy("block", "term").agg(
            F.count("*").alias("occurrences"),
            F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("_chunks"),
            F.sum("weight").alias("weight"),
            F.sum("position").alias("positions"),
        )
        return in_block.groupBy("term").agg(
            F.sum("occurrences").alias("occurrences"),
            F.sum(F.coalesce(F.bit_count("_chunks"), F.lit(0))).alias("chunks"),
            F.sum("weight").alias("weight"),
            F.sum("positions").alias("positions"),
        )
    return (
        chunk_terms(postings)
        .groupBy("term")
        .agg(
            F.sum("occurrences").alias("occurrences"),
            F.count("id").alias("chunks"),
            F.sum("weight").alias("weight"),
            F.sum("positions").alias("positions"),
        )
    )


def stem_totals(postings: DataFrame) -> DataFrame:
    """Rows (stem, occurrences, chunks, terms, weight). The vocabulary is written, so that its size tells
    whether each chunk's postings can be added up by stem where they are made."""
    vocabulary = cut_lineage(build_vocabulary(postings))
    if vocabulary.count() <= MOST_BROADCAST:
        stemmed = postings.withColumn("occurrences", F.lit(1)).join(F.broadcast(vocabulary), "term")
    else:
        stemmed = chunk_terms(postings).join(vocabulary, "term")
    in_chunk = stemmed.groupBy("id", "stem").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("weight").alias("weight")
    )
    counted = in_chunk.groupBy("stem").agg(
        F.sum("occurrences").alias("occurrences"), F.count("id").alias("chunks"), F.sum("weight").alias("weight")
    )
    return counted.join(vocabulary.groupBy("stem").agg(F.count("term").alias("terms")), "stem").select(
        "stem", "occurrences", "chunks", "terms", "weight"
    )


def build_vocabulary(postings: DataFrame) -> DataFrame:
    """Distinct terms with their stems: the only place where a stem is computed."""
    return postings.select("term").distinct().withColumn("stem", stem_terms(F.col("term")))


def parse_queries(queries: DataFrame, english: bool = True) -> DataFrame:
    """Rows (query_id, units): web-style queries as units of an OR of ANDs.

    A unit is (alternative, negated, terms); terms are (key, offset). Words of one alternative must
    all occur, quoted words in sequence, words after ``-`` not at all; ``or`` starts the next
    alternative. Keys are stems when ``english``.
    """
    tokens = queries.select(
        "query_id",
        F.regexp_extract_all(F.lower("query"), F.lit('-?"[^"]*"|\\S+'), F.lit(0)).alias("_tokens"),
    )

    def unit(token: Column, i: Column) -> Column:
        terms = F.transform(
            word_tokens(token), lambda term, n: F.struct(term.alias("key"), n.cast("int").alias("offset"))
        )
        if english:
            terms = F.filter(terms, lambda t: ~_is_stop_word(t["key"]))
        return F.struct(
            F.size(F.filter(F.slice(F.col("_tokens"), 1, i + 1), lambda t: t == "or"))
            .cast("int")
            .alias("alternative"),
            token.startswith("-").alias("negated"),
            F.when(token != "or", terms).alias("terms"),
        )

    parsed = tokens.withColumn("units", F.transform("_tokens", unit)).withColumn(
        "units", F.filter("units", lambda u: F.coalesce(F.size(u["terms"]), F.lit(0)) > 0)
    )
    if english:
        keys = F.array_distinct(F.flatten(F.transform("units", lambda u: F.transform(u["terms"], lambda t: t["key"]))))
        words = parsed.select(F.explode(keys).alias("key")).distinct()
        stems = words.withColumn("stem", stem_terms(F.col("key")))
        per_query = (
            parsed.select("query_id", F.explode(keys).alias("key"))
            .join(stems, "key")
            .groupBy("query_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("key", "stem"))).alias("_stems"))
        )
        parsed = parsed.join(per_query, "query_id").withColumn(
            "units",
            F.transform(
                "units",
                lambda u: F.struct(
                    u["alternative"].alias("alternative"),
                    u["negated"].alias("negated"),
                    F.transform(
                        u["terms"],
                        lambda t: F.struct(
                            F.element_at(F.col("_stems"), t["key"]).alias("key"), t["offset"].alias("offset")
                        ),
                    ).alias("terms"),
                ),
            ),
        )
    return parsed.select("query_id", "units")


def keyword_search(
    postings: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Rows (query_id, id, keyword_rank, keyword_order): per query the k best chunks, ties by id.

    With a vocabulary, terms match by stem and stop words of the query are ignored; without one,
    terms match as they are. An alternative needs at least one word that is not negated.
    A column ``keyword_match_count`` of ``queries`` overrides k per query.
    """
    english = vocabulary is not None
    members = _members(queries)
    asked = members.filter(F.col("query_id") == F.col("_asks")).select("query_id", F.explode("_form").alias("query"))
    parsed = cut_lineage(with_keys(parse_queries(asked, english)).withColumn("_plain", is_plain(F.col("units"))))
    # Written once, so that the vocabulary is made once.
    terms = cut_lineage(query_terms(parsed, vocabulary))
    # Which kinds there are is asked of the queries alone, so that postings are read once for each.
    kinds = {row["_plain"] for row in parsed.select("_plain").distinct().collect()}
    ranked = None
    if True in kinds or not kinds:
        asked = cut_lineage(terms.join(parsed.filter("_plain"), "query_id", "left_semi"))
        # A term's weights in a chunk are added up once, not for each query that asks for the term.
        own = postings.join(asked.select("term").distinct(), "term", "left_semi")
        ranked = sum_ranks(own.groupBy("id", "term").agg(F.sum("weight").alias("weight")).join(asked, "term"))
    if False in kinds:
        others = parsed.filter(~F.col("_plain"))
        simple = None
        if not english:
            others, marks = part_alternatives(others)
            # Written once, for the keys that are left are asked for again.
            others, marks = cut_lineage(others), cut_lineage(marks.join(terms, ["query_id", "key_no"]))
            simple = postings.join(marks, "term")
            simple = (
                simple.groupBy("query_id", "alternative", "id")
                .agg(F.sum(F.when(~F.col("negated"), F.col("weight"))).alias("keyword_rank"), F.bool_or("negated").alias("_not"))
                .filter(~F.col("_not") & F.col("keyword_rank").isNotNull())
                .select("query_id", "id", "keyword_rank")
            )
            needed = others.select("query_id", F.explode(F.flatten(F.col("units.terms"))).alias("_t"))
            needed = needed.select("query_id", F.col("_t.key").alias("term")).distinct()
            wanted = terms.join(needed, ["query_id", "term"], "left_semi")
        else:
            wanted = terms.join(others, "query_id", "left_semi")
        if not english and "after" in postings.columns:
            wanted = cut_lineage(wanted.join(phrase_places(others), ["query_id", "key_no"], "left"))
            fits = lambda own, asked: F.col(asked).isNull() | F.col(own).isNull() | (F.col(own) == F.col(asked))
            hits = postings.join(wanted, "term").filter(fits("before", "_before") & fits("after", "_after"))
        else:
            hits = postings.join(wanted, "term")
        covers = rank_hits(hits, others, None if simple is not None else RANK_DIGITS)
        if simple is not None:
            covers = (
                covers.unionByName(simple)
                .groupBy("query_id", "id")
                .agg(F.round(F.sum("keyword_rank"), RANK_DIGITS).alias("keyword_rank"))
            )
        ranked = covers if ranked is None else ranked.unionByName(covers)
    same = members.select("query_id", "_asks")
    return best_hits(ranked, queries, k, same)


def _members(queries: DataFrame) -> DataFrame:
    """Rows (query_id, _form, _asks): what a query asks, and the least query that asks the same. Searches
    grow with the questions that differ, not with the queries; written once, it is narrow."""
    forms = (
        queries.filter(F.col("query_id").isNotNull() & F.col("query").isNotNull())
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list("query")).alias("_form"))
    )
    forms = cut_lineage(forms)
    asks = forms.groupBy("_form").agg(F.min("query_id").alias("_asks"))
    return cut_lineage(forms.join(asks, "_form").select("query_id", "_form", "_asks"))


def hit_limit(queries: DataFrame, k: int | None = None) -> Column:
    """How many hits a query gets: its keyword_match_count, or ``k``, or the default."""
    limit = F.lit(k if k is not None else SearchDefaults().keyword_match_count)
    return F.coalesce(F.col("keyword_match_count"), limit) if "keyword_match_count" in queries.columns else limit


def best_hits(
    ranked: DataFrame, queries: DataFrame, k: int | None = None, same: DataFrame | None = None
) -> DataFrame:
    """The k best rows (query_id, id, keyword_rank) of each query with their order, ties by id. With ``same``,
    rows (query_id, _asks), a query takes the ranked rows of the query that asks for it."""
    limit = hit_limit(queries, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("keyword_rank"), F.asc("id"))
    ordered = ranked.withColumn("keyword_order", F.row_number().over(order))

    def given(rows: DataFrame) -> DataFrame:
        return rows if same is None else rows.withColumnRenamed("query_id", "_asks").join(same, "_asks").select(*ordered.columns)

    if "keyword_match_count" not in queries.columns:
        return given(ordered.filter(F.col("keyword_order") <= limit))
    limits = queries.select("query_id", limit.cast("int").alias("_limit"))
    # The largest limit, as a number, lets every task cut its part of a query before the shuffle.
    most = limits.agg(F.max("_limit")).first()[0] or 0
    return (
        given(ordered.filter(F.col("keyword_order") <= most))
        .join(limits, "query_id")
        .filter(F.col("keyword_order") <= F.col("_limit"))
        .drop("_limit")
    )


def with_keys(parsed: DataFrame) -> DataFrame:
    """Parsed queries with ``keys``, the distinct keys of their units."""
    every = F.flatten(F.transform("units", lambda u: F.transform(u["terms"], lambda t: t["key"])))
    return parsed.withColumn("keys", F.array_distinct(every))


def query_terms(parsed: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """Rows (query_id, key_no, term): the terms of each key, by stem where there is a vocabulary."""
    keys = parsed.select("query_id", F.posexplode("keys").alias("key_no", "key"))
    if vocabulary is None:
        return keys.withColumnRenamed("key", "term")
    return keys.join(vocabulary, keys["key"] == vocabulary["stem"]).select("query_id", "key_no", "term")


def _one_each(units: Column) -> Column:
    """Whether each alternative has at most one unit that is not negated."""
    return F.forall(
        units,
        lambda u: F.size(F.filter(units, lambda v: (v["alternative"] == u["alternative"]) & ~v["negated"])) <= 1,
    )


def part_alternatives(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries without the alternatives that are one word, with or without negated words, and those as rows
    (query_id, alternative, key_no, negated).

    Only of queries in which no key is repeated and each alternative has one unit that is not negated. There
    no stretch lies in another, so ranks add up, and a word's rank is the sum of its weights.
    """
    units = F.col("units")
    own = lambda u: F.filter(units, lambda v: v["alternative"] == u["alternative"])
    words = F.flatten(F.transform(units, lambda u: F.transform(u["terms"], lambda t: t["key"])))
    apart = _one_each(units) & (F.size(words) == F.size("keys"))
    is_simple = lambda u: apart & F.forall(own(u), lambda v: F.size(v["terms"]) == 1)
    marked = parsed.withColumn("_simple", F.filter(units, is_simple))
    rest = marked.withColumn("units", F.filter(units, lambda u: ~is_simple(u))).drop("_simple")
    listed = marked.select("query_id", "keys", F.explode("_simple").alias("_u"))
    number = (F.array_position("keys", F.get(F.col("_u.terms"), F.lit(0))["key"]) - 1).cast("int")
    return rest.filter(F.size("units") > 0), listed.select(
        "query_id", "_u.alternative", number.alias("key_no"), "_u.negated"
    )


def phrase_places(parsed: DataFrame) -> DataFrame:
    """Rows (query_id, key_no, _before, _after): the words beside a key that has one place in its query, in a
    phrase. Only such occurrences of it count, where each alternative has at most one unit that is not
    negated: its stretches are its phrases, and nothing else lies inside them."""
    alone = _one_each(F.col("units"))
    beside = lambda u, place: F.get(u["terms"], place)["key"]
    places = F.flatten(
        F.transform(
            "units",
            lambda u: F.transform(
                u["terms"],
                lambda t, i: F.struct(
                    t["key"].alias("key"), beside(u, i - 1).alias("_before"), beside(u, i + 1).alias("_after")
                ),
            ),
        )
    )
    listed = parsed.filter(alone).select("query_id", "keys", F.explode(places).alias("_place"))
    number = (F.array_position("keys", F.col("_place.key")) - 1).cast("int")
    return (
        listed.select("query_id", number.alias("key_no"), "_place._before", "_place._after")
        .groupBy("query_id", "key_no")
        .agg(F.count("*").alias("_places"), F.first("_before").alias("_before"), F.first("_after").alias("_after"))
        .filter("_places = 1")
        .drop("_places")
    )


def is_plain(units: Column) -> Column:
    """Whether every alternative is one plain word: then each occurrence is a cover of its own and the
    rank is the sum of the weights, which is added up before the shuffle. Other queries need positions."""
    return F.forall(
        units,
        lambda u: ~u["negated"]
        & (F.size(u["terms"]) == 1)
        & (F.size(F.filter(units, lambda v: v["alternative"] == u["alternative"])) == 1),
    )


def sum_ranks(hits: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows (query_id, id, keyword_rank) of plain queries. ``within``: columns that an id has one value of, by which hits are dealt out."""
    ranks = hits.groupBy(*within, "query_id", "id").agg(F.round(F.sum("weight"), RANK_DIGITS).alias("keyword_rank"))
    return ranks.select("query_id", "id", "keyword_rank")


def needed_keys(units: Column) -> Column:
    """Per alternative the keys that must all occur."""
    return F.transform(
        F.array_distinct(F.transform(units, lambda u: u["alternative"])),
        lambda a: F.flatten(
            F.transform(
                F.filter(units, lambda u: (u["alternative"] == a) & ~u["negated"]),
                lambda u: F.transform(u["terms"], lambda t: t["key"]),
            )
        ),
    )


def rank_hits(
    hits: DataFrame, parsed: DataFrame, digits: int | None = RANK_DIGITS, within: tuple[str, ...] = ()
) -> DataFrame:
    """Rows (query_id, id, keyword_rank) of queries that need the positions of their terms.

    ``hits`` are (query_id, id, key_no, position, weight). They are moved once: words and positions are
    gathered together, and chunks that lack a word of each alternative are dropped before any cover
    is looked for. Hits that are dealt out by the columns ``within``, of which an id has one value, are not moved.
    """
    # Sets of keys as bits of numbers, as many as the longest query needs.
    longest, keys = parsed.agg(F.coalesce(F.max(F.size("keys")), F.lit(0)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    words = range(longest // _BITS + 1)
    bit = F.expr(f"shiftleft(1L, key_no % {_BITS})")
    have = [F.bit_or(F.when(F.floor(F.col("key_no") / _BITS) == w, bit)).alias(f"_have{w}") for w in words]

    def mask(keys: Column, word: int) -> Column:
        place = lambda key: (F.array_position(F.col("keys"), key) - 1).cast("int")
        return F.aggregate(
            keys,
            F.lit(0).cast("long"),
            lambda bits, key: F.when(
                F.floor(place(key) / _BITS) == word,
                bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(key) % _BITS)),
            ).otherwise(bits),
        )

    masks = F.transform(
        F.filter(needed_keys(F.col("units")), lambda keys: F.size(keys) > 0),
        lambda keys: F.array(*[mask(keys, w) for w in words]),
    )

    def holds(needed: Column) -> Column:
        whole = F.lit(True)
        for w in words:
            whole &= F.coalesce(F.col(f"_have{w}"), F.lit(0)).bitwiseAND(needed[w]) == needed[w]
        return whole

    asked = parsed.select("query_id", "keys", "units", masks.alias("_needed"))
    found = (
        hits.groupBy(*within, "query_id", "id")
        .agg(*have, F.collect_list(F.struct("position", "key_no", "weight")).alias("entries"))
        .join(F.broadcast(asked) if keys <= MOST_BROADCAST else asked, "query_id")
        .filter(F.exists("_needed", holds))
        .select("query_id", "id", "entries", "keys", "units")
    )
    kinds = dict(found.dtypes)
    ranked = rank_covers(found, kinds["id"], kinds["query_id"])
    return ranked if digits is None else ranked.withColumn("keyword_rank", F.round("keyword_rank", digits))
