"""Domain lexicon: matching of patterns in sentences, routing, unions and phrase lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from chalkline.functions import text as texts_
from chalkline.operators.automaton import contained
from chalkline.operators.ordered import budget_prefix, first_wins

#: A lexicon of at most so many patterns is sent to the tasks; a larger one is met by automata.
BROADCAST_PATTERNS = 20_000
#: Phrases that a task holds back at most; with more keys than these allow it hands on what it has.
HELD_PHRASES = 200_000


def matches(sentence: Column, pattern: Column, exclusions: Column | None = None) -> Column:
    """Whether a pattern is in a sentence: ASCII ones between non-alphanumeric characters, others anywhere.

    Exclusions (an array of contexts) are taken out of the sentence first.
    """
    text = F.lower(sentence)
    if exclusions is not None:
        text = F.aggregate(F.coalesce(exclusions, F.array().cast("array<string>")), text, lambda a, x: F.replace(a, F.lower(x), F.lit(" ")))
    wanted = F.lower(pattern)
    bounded = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), wanted, F.lit(r"\E(?![A-Za-z0-9])"))
    ascii_ = ~wanted.rlike(r"[^\x00-\x7F]")
    return F.contains(text, wanted) & (~ascii_ | F.regexp_like(text, bounded))


def candidates(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sentence rows with each pattern that may be in them.

    A small lexicon goes to the tasks as a whole; a larger one is met by automata. Both give equal rows.
    """
    if lexicon.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        return sentences.join(F.broadcast(lexicon), F.contains(F.lower("sentence"), F.lower("pattern")))
    return contained(sentences, lexicon, "sentence", "pattern")


def route(sentences: DataFrame, lexicon: DataFrame, strong: str = "GLOSSARY_TERM") -> DataFrame:
    """(sentence_id, use_rag, reasons, terms, query) of each sentence.

    ``sentences``: (sentence_id, sentence); ``lexicon``: (ord, pattern, canonical, reason, exclusions). A
    canonical term has its first pattern's reason unless one of its patterns is a glossary term. The query
    is the sentence and those terms that it lacks, in order of match.
    """
    hit = candidates(sentences, lexicon).where(matches(F.col("sentence"), F.col("pattern"), F.col("exclusions")))
    by_term = hit.groupBy("sentence_id", "canonical").agg(
        F.min("ord").alias("_ord"), F.first("sentence").alias("_s"),
        F.coalesce(F.max(F.when(F.col("reason") == strong, strong)), F.min_by("reason", "ord")).alias("_reason"),
    )
    missing = ~F.contains(F.lower("_s"), F.lower("canonical"))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(missing, F.struct("_ord", "canonical")))), lambda x: x["canonical"])
    routed = by_term.groupBy("sentence_id").agg(
        F.array_join(F.array_sort(F.collect_set("_reason")), ",").alias("reasons"),
        F.array_join(F.array_sort(F.collect_set("canonical")), ",").alias("terms"), ordered.alias("_more"),
    )
    out = sentences.join(routed, "sentence_id", "left")
    return out.select(
        "sentence_id", F.col("terms").isNotNull().alias("use_rag"), F.coalesce("reasons", F.lit("")).alias("reasons"),
        F.coalesce("terms", F.lit("")).alias("terms"), F.concat_ws(" ", "sentence", F.array_join("_more", " ")).alias("query"),
    )


def united(*sources: DataFrame) -> DataFrame:
    """Union of lexicon sources; of equal patterns (in lower case) the first source's stays."""
    out = None
    for k, source in enumerate(sources):
        one = source.withColumn("_source", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return first_wins(out, F.lower("pattern"), ["_source", "ord"]).drop("_source")


def phrase_list(phrases: DataFrame, keys: list[str], items: int = 500, chars: int = 8000) -> DataFrame:
    """Normalised phrases, each once, by priority, while they fit the budget.

    ``phrases``: (keys, priority, ord, phrase) with a normalised phrase (null ones go); ``ord`` may be a
    struct. Tasks reduce a phrase to its first row before the shuffle.
    """
    once = phrases.where("phrase is not null").groupBy(*keys, F.lower("phrase").alias("_lower")).agg(F.min(F.struct("priority", "ord", "phrase")).alias("_first"))
    return budget_prefix(once.select(*keys, "_first.*"), keys, ["priority", "ord"], "phrase", items, chars)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _first_of(words: Column, items: int) -> Column:
    """The first ``items`` phrases among raw ones by place: (k, phrase, lower), each once."""

    def placed(named: Column, lower: Column) -> Column:
        row = lambda k, x: F.struct(k.cast("int").alias("k"), F.get(named, k.cast("int") - 1).alias("phrase"), x.alias("lower"))
        return F.transform(F.slice(F.filter(F.array_distinct(lower), lambda x: x.isNotNull()), 1, items), lambda x: _once(F.array_position(lower, x), lambda k: row(k, x)))

    return _once(F.transform(words, texts_.phrase), lambda named: _once(F.transform(named, F.lower), lambda lower: placed(named, lower)))


def leading_phrases(texts: DataFrame, keys: list[str], ord: str, items: int = 500) -> DataFrame:
    """(keys, priority, ord struct(ord, k), phrase): what of all phrases of texts can be on a list of ``items``.

    ``texts``: (keys, priority, ord, text), with blanks between raw phrases. A phrase of the list has fewer than ``items``
    others before its first place, so fewer in its text and in its task, too: each text gives its first ``items``
    phrases, and a task keeps as many of each key. A list of these is the list of all phrases.
    """
    some = 3 * items  # a text's first words mostly have enough phrases; the others' are taken from all words
    head = F.split("text", " ", some + 1)
    own = _once(_first_of(F.slice(head, 1, some), items), lambda x: F.when((F.size(x) >= items) | (F.size(head) <= some), x).otherwise(_first_of(F.split("text", " "), items)))
    rows = texts.where("text is not null").select(*keys, "priority", ord, own.alias("_own"))
    at, types = len(keys), rows.schema
    place = StructType([types[ord], StructField("k", types["_own"].dataType.elementType["k"].dataType)])
    schema = StructType([*(types[k] for k in keys), types["priority"], StructField("ord", place), StructField("phrase", types["_own"].dataType.elementType["phrase"].dataType)])
    arrow = to_arrow_schema(schema)

    def kept(best: dict) -> pa.RecordBatch:
        out = [(*key, p, {ord: o, "k": k}, phrase) for key, (found, _) in best.items() for ((_, p), (_, o), k, phrase) in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(arrow), arrow)], schema=arrow)

    def reduce(batches):
        best, held = {}, 0  # of each key: the places of its first phrases by lower case, and the last one when they are enough
        for batch in batches:
            *names, priorities, ords = (c.to_pylist() for c in batch.columns[: at + 2])
            for i, (*key, p, o) in enumerate(zip(*names, priorities, ords)):
                start = ((p is not None, p), (o is not None, o))
                found, last = best.get(key := tuple(key), ({}, None))
                if last and start > last[:2]:
                    continue
                for x in batch.column(at + 2)[i].as_py():
                    row = (*start, x["k"], x["phrase"])
                    if last and row > last:
                        break
                    if x["lower"] not in found or row < found[x["lower"]]:
                        held += x["lower"] not in found
                        found[x["lower"]] = row
                        if len(found) > items:
                            del found[max(found, key=found.get)]
                            held -= 1
                        last = max(found.values()) if len(found) == items else None
                best[key] = found, last
            if held > HELD_PHRASES:
                yield kept(best)
                best, held = {}, 0
        yield kept(best)

    return rows.mapInArrow(reduce, schema)


def glossary_hits(sentences: DataFrame, terms: DataFrame, extra: Column | None = None) -> DataFrame:
    """(sentence_id, hits): glossary terms in a sentence in glossary order, then further ones, each once."""
    hit = sentences.join(F.broadcast(terms), F.contains("sentence", "term")) if terms.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS else candidates(
        sentences, terms.withColumnRenamed("term", "pattern")
    ).where(F.contains("sentence", "pattern")).withColumnRenamed("pattern", "term")
    found = hit.groupBy("sentence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]).alias("_h"))
    own = F.coalesce("_h", F.array().cast("array<string>"))
    return sentences.join(found, "sentence_id", "left").select("sentence_id", (F.array_union(own, extra) if extra is not None else own).alias("hits"))


def glossary_hints(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """(sentence_id, hint): a line for each hit with the translations that its glossary entry prescribes, in order of hits.

    ``hits``: (sentence_id, hits array); ``entries``: (term, definition, translations map), of equal terms the last by
    ``ord`` counts. Hits without an entry, and entries without translations, give no line; a sentence without lines an
    empty hint.
    """
    last = entries.groupBy("term").agg(F.max_by(F.struct("definition", "translations"), "ord").alias("e")).select("term", "e.*")
    last = last.where(F.size("translations") > 0)
    said = F.transform(F.array_sort(F.map_entries("translations")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    meaning = F.when(F.coalesce("definition", F.lit("")) != "", F.concat(F.lit(" ("), "definition", F.lit(")"))).otherwise("")
    lines = hits.select("sentence_id", F.posexplode("hits").alias("k", "term")).join(last, "term")
    lines = lines.select("sentence_id", "k", F.concat(F.lit("- "), "term", meaning, F.lit(" → "), F.array_join(said, ", ")).alias("line"))
    joined = lines.groupBy("sentence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("hint"))
    return hits.select("sentence_id").join(joined, "sentence_id", "left").select("sentence_id", F.coalesce("hint", F.lit("")).alias("hint"))


def retriggered(routed: DataFrame, hints: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``routed`` (route's rows of one fixed major) with a second try for the sentences that nothing triggered.

    ``hints``: (sentence_id, hits array of glossary terms). The sentence with its hints is routed again; those without
    hints stay off.
    """
    off = routed.where("not use_rag").select("sentence_id", F.col("query").alias("_said"))
    again = off.join(hints.where(F.size("hits") > 0), "sentence_id").select("sentence_id", F.concat_ws(" ", "_said", F.array_join("hits", " ")).alias("sentence"))
    second = route(again, lexicon).where("use_rag")
    return routed.join(second.select("sentence_id"), "sentence_id", "left_anti").unionByName(second)


def diagnostics(glossary: DataFrame, lexicon: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """(key, n_glossary, n_lexicon, n_phrases, n_phrase_chars): how much each session's aids hold; sessions of any of them."""
    one = lambda df, **aggregates: df.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()])
    n = F.count(F.lit(1))
    out = one(glossary, n_glossary=n).join(one(lexicon, n_lexicon=n), key, "full").join(one(phrases, n_phrases=n, n_phrase_chars=F.sum(F.length("phrase"))), key, "full")
    return out.na.fill(0)
