"""Spelling variants by merging an errata trie: words at one edit, and the form that each variant stands for.

The words make a trie. At each of its nodes the child with the most words goes on the heavy path; the others, and the
end of a word that stops there, are light. A light subtree is merged into the one of its node, once with the
character at the node replaced by the heavy one, once with it skipped, and once behind the heavy one. Where a merged
word ends at a terminal of the trie, the two words are one edit apart. Words of two light subtrees of a node meet by
their rests. Small subtrees go into large ones, so a word is merged at no more nodes than the logarithm of the number
of words, not at each of its characters. With the first difference of two words at their last common node, each pair
is met at that node only, and once: a skipped character that equals the next is left out, as its pair parts later.

The trie is a table of (prefix, next character) counts, and merging is an equality join of words on their light
edges, then of the merged words on the words: no task holds a subtree. Hot edges (those near the root) stand alone on
one side of a join, so adaptive execution splits the other. Of words that meet by their rests (an alphabet at most)
each gets their number and the best other one, not all pairs.

Defined results: a null text has no words; repeated words in ``words`` are to be summed before; null words and words
without count are left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.session import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the letters of a run.
LETTERS = r"[A-Za-zÀ-ÿ]"


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, slips: int = 199) -> DataFrame:
    """``word``, a row for each run of letters with A-Z lower-cased; where ``slips`` divides the hash of a document's key
    and run, the run lacks one character. Runs of under ``least_length`` characters are left out, before and after."""
    found = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(found).alias("run"))
    plain = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    runs = runs.select(F.concat_ws(":", "key", plain).alias("seed"), plain.alias("run")).withColumn("h", F.crc32(F.encode("seed", "UTF-8")))
    at = F.pmod("h", F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)


def counted(words: DataFrame, least: int = 5) -> DataFrame:
    """``word`` and ``n`` of the words with at least ``least`` rows."""
    return words.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _rest(word: str, at: str, skip: int) -> Column:
    return F.substring(word, F.col(at) + 1 + skip, F.length(word))


def _edges(words: DataFrame) -> DataFrame:
    """A row for each edge on a word's path: prefix, and the next character, empty at the word's end."""
    deep = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    return deep.select("word", "n", "at", F.substring("word", F.lit(1), F.col("at")).alias("prefix"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("char"))


def light_edges(words: DataFrame) -> DataFrame:
    """(prefix, char) of each edge off the heavy paths, with the heavy character of its node."""
    size = F.struct(F.col("char") != "", F.col("size"), F.col("char"))
    children = _edges(words).groupBy("prefix", "char").agg(F.count("*").alias("size"))
    nodes = children.groupBy("prefix").agg(F.max_by("char", size).alias("heavy"), F.collect_list("char").alias("chars")).where(F.size("chars") > 1)
    return nodes.select("prefix", "heavy", F.explode("chars").alias("char")).where("char <> heavy")


def _merged(words: DataFrame) -> DataFrame:
    """A row for each word and light edge on its path."""
    light = cut(light_edges(words)).withColumnsRenamed({"prefix": "_prefix", "char": "_char"})
    edges = _edges(words)
    return edges.join(light, (edges.prefix == light["_prefix"]) & (edges.char == light["_char"])).drop("_prefix", "_char")


def near(words: DataFrame) -> DataFrame:
    """For each of ``words`` (word, n) with words at one edit: their number, and the one of largest n (then the first by
    code points) as ``best`` (n negated, word)."""
    merged = cut(_merged(words))
    prefix, replaced = F.col("prefix"), F.col("char") != ""
    parts_here = replaced & (F.substring("word", F.col("at") + 2, F.lit(1)) != F.col("char"))
    ways = F.array(
        F.when(replaced, F.concat(prefix, "heavy", _rest("word", "at", 1))),
        F.when(parts_here, F.concat(prefix, _rest("word", "at", 1))),
        F.concat(prefix, "heavy", _rest("word", "at", 0)),
    )
    ends = merged.select("word", "n", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("end"))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = ends.join(known, ends.end == known.other)
    best = lambda n, word: F.struct((-F.col(n)).alias("n"), F.col(word).alias("word"))
    sides = F.array(
        F.struct(F.col("word"), F.lit(1).cast("long").alias("n_near"), best("other_n", "other").alias("best")),
        F.struct(F.col("other").alias("word"), F.lit(1).cast("long").alias("n_near"), best("n", "word").alias("best")),
    )
    met = pairs.select(F.inline(sides))

    alike = merged.where(replaced).groupBy("at", F.concat(prefix, _rest("word", "at", 1)).alias("rest"))
    alike = alike.agg(F.sort_array(F.collect_list(best("n", "word"))).alias("all")).where(F.size("all") > 1)
    alike = alike.select("all", F.posexplode("all").alias("k", "own"))
    alike = alike.select("own.word", (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("k") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    return met.unionByName(alike).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for each of ``forms`` (word, form): forms followed to the last, twice as far each round."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = links.join(on, links.root == on["_word"], "left")
        links, before = cut(further.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))), links
        if links.where("moved").isEmpty():
            return before.select("word", "root")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``words`` (word, n) with n_near, form (the best word at one edit, if its n is ``times`` the word's), form_n, root."""
    words = cut(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")))
    best = near(words).withColumnsRenamed({"word": "_word"})
    found = words.join(best, words.word == best["_word"], "left").drop("_word")
    good = -F.col("best.n") >= times * F.col("n")
    found = cut(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n")
    ))
    last = roots(found.where("form is not null")).withColumnsRenamed({"word": "_word", "root": "_root"})
    found = found.join(last, found.word == last["_word"], "left")
    return found.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
