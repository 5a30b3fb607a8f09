"""Spelling variants by a relational trie frontier.

The words make a trie whose unary chains are joined into one edge, kept as a table ``(level, node, label, child)`` in a
folder per level. States ``(word, position, node, edits)`` start at the root; each level joins them with the edges of that level.
A state without an edit follows its own path and leaves it at the first sign that differs, by an inserted, replaced or
deleted sign; a state with its edit spent follows the one edge that starts with its next sign. A state that ends at
the end of a word with one edit is a neighbour. As the edit is made at the first difference, each pair is found once
from either side. Edges know the lengths of the words below them and the signs that may follow, so most states that
cannot end are never written.

Nodes are 127-bit fingerprints of prefixes, computed along the word. Each level is written and the level before
deleted; nothing but counts reaches the driver. A word has as many levels as its path has branches, so long runs of
signs are no problem.

Forms (the most frequent near word, if frequent enough) point to strictly more frequent words, so they have no
cycles; roots are found by doubling pointers.

Cases: null and empty texts have no words; a null id is the empty text before the colon; repeated rows count each;
texts and words of any length are read whole; ties of forms go to the smallest word in code-point order; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import calls, in_workers
from quayside.storage import delete_path, fresh_path, materialise

CHANGED, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 199, 6, 5, 5
# Distinct words counted in a task before they are sent on.
HELD_WORDS = 400_000
ROOT = bytes(16)
_PRIME, _BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15
# Latin-1 codes that are letters of a word, A-Z in lower case; every other sign is a gap.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))
_LAST_BIT = 62
# Prefixes of up to so many signs are nodes without a look at their branches.
SHORT = 2
# Edges of a level that are broadcast at most: one row takes some hundred bytes.
LEVEL_ROWS = 60_000
# Words that a task takes from the root.
WORDS_PER_TASK = 20_000
STEPS = "id long, at int, node binary, next string"
EDGES = "node binary, label string, child binary, depth int, lengths long, ends long, signs long, first string"
STATES = "word long, position int, rest string, node binary, edits int, found long, able boolean"


def utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def changed_words(doc_id: str, text: str) -> tuple[list[bytes], list[tuple[bytes, bytes, int]]]:
    """Words of a text in Latin-1, and ``(word, result, times)`` of those that lose a code point."""
    words = text.encode("latin-1", "replace").translate(_LETTERS).split()
    start, crc, lost = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32, []
    for word in set(words):
        h = crc(utf8(word), start)
        if not h % CHANGED:
            at = h % len(word)
            lost.append((word, word[:at] + word[at + 1 :], words.count(word)))
    return words, lost


def counted_words(docs: DataFrame) -> DataFrame:
    """``id, word, n, node``: the words that are long and frequent enough, at the root, written once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(x.decode("latin-1"), n) for x, n in held.items() if n and len(x) >= LEAST_LENGTH]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for cut in calls(batch):
                for doc_id, text in zip(cut.column("doc_id").to_pylist(), cut.column("text").to_pylist()):
                    words, lost = changed_words(doc_id or "", text or "")
                    held.update(words)
                    for word, result, times in lost:
                        held[word] -= times
                        held[result] += times
                if len(held) > HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"))
    words = in_workers(texts, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")
    # The root is written with the words: as a literal it would turn the first join into a nested loop.
    return materialise(words.select(F.monotonically_increasing_id().alias("id"), "word", "n", F.lit(ROOT).alias("node")), "variant-words")


def prefixes(words: DataFrame) -> DataFrame:
    """``id, at, node, next`` of every prefix of every word but the empty one; the whole word is followed by ''."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in calls(batch, "word"):
                ids, ats, nodes, following = [], [], [], []
                for own, word in zip(cut.column("id").to_pylist(), cut.column("word").to_pylist()):
                    h = 0
                    for at, sign in enumerate(word, 1):
                        h = (h * _BASE + ord(sign) + 1) % _PRIME
                        nodes.append(h.to_bytes(16, "big"))
                        following.append(word[at : at + 1])
                        ats.append(at)
                    ids += [own] * len(word)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(nodes, pa.binary()),
                                                  pa.array(following, pa.string())], ["id", "at", "node", "next"])

    return in_workers(words.select("id", "word"), split, STEPS)


def bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.least(number, F.lit(_LAST_BIT)).cast("int"))


def sign_bit(sign: Column) -> Column:
    """A bit for the first sign of a text; several signs share one."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(sign) % 63).cast("int"))


def edge_table(words: DataFrame, path: str) -> list[int]:
    """Write the edges below ``path``, a folder per level; returns the edges of each level.

    ``word`` is the word that ends at the child, ``depth`` the length of its prefix, ``lengths`` has a bit for the
    length of each word at or below it, ``signs`` one for the first sign of each edge below it.
    """
    spark = words.sparkSession
    stepped = fresh_path(spark, "variant-prefixes")
    prefixes(words).write.parquet(stepped)
    steps = spark.read.schema(STEPS).parquet(stepped)
    # Short prefixes stay nodes whether they branch or not: they are few, and their rows are too many for one key.
    short, long = steps.where(F.col("at") <= SHORT), steps.where(F.col("at") > SHORT)
    kept = long.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).where("a < b or a = ''").select("node")
    places = short.select("id", "at", "node").unionByName(long.join(kept, "node", "left_semi").select("id", "at", "node")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("stops"))
    stop, before = F.get("stops", F.col("level")), F.get("stops", F.col("level") - 1)
    from_at = F.coalesce(before["at"], F.lit(0))
    cut = places.join(words.select("id", "word"), "id").select("id", "word", "stops", F.explode(F.sequence(F.lit(0), F.size("stops") - 1)).alias("level")).select(
        "level", F.coalesce(before["node"], F.lit(ROOT)).alias("node"),
        F.substring(F.col("word"), from_at + 1, stop["at"] - from_at).alias("label"),
        stop["node"].alias("child"), stop["at"].alias("depth"), bit(F.length("word")).alias("lengths"),
        F.substring(F.col("word"), stop["at"] + 1, F.lit(1)).alias("next"),
        F.when(stop["at"] == F.length("word"), F.col("id")).alias("ends"))
    edges = cut.groupBy("level", "node", "label", "child").agg(
        F.max("depth").alias("depth"), F.bit_or("lengths").alias("lengths"), F.max("ends").alias("ends"),
        F.coalesce(F.bit_or(F.when(F.col("next") != "", sign_bit(F.col("next")))), F.lit(0).cast("long")).alias("signs"))
    edges = edges.withColumn("first", F.substring("label", 1, 1))
    edges.write.partitionBy("level").parquet(path)
    delete_path(spark, stepped)
    if words.isEmpty():
        return []
    return [n for _, n in sorted(map(tuple, spark.read.parquet(path).groupBy("level").count().collect()))]


def moved(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one edge: ``found`` is the word that ends there one edit away, ``able`` tells which may go on."""
    n, left, way = F.length("label"), F.length("rest"), F.col("way")
    whole = F.startswith("rest", "label")
    # Ways to take a label: as it is, or with its sign left out, replaced, or after a sign that is skipped.
    taken = F.when(way == 1, n - 1).when(way == 3, n + 1).otherwise(n)
    # Most labels near the root are one sign, where a look at the next one tells what the distance would.
    sign = (way == 1) | (way == 2) & (left >= 1) | (way == 3) & (F.substring("rest", 2, 1) == F.col("label"))
    longer = (left >= taken) & (F.levenshtein("label", F.substring(F.col("rest"), F.lit(1), taken), 1) == 1)
    columns = ["word", "position", "rest", "child", "depth", "lengths", "ends", "signs"]
    fresh = states.where("edits = 0").join(edges, "node").withColumn("way", F.explode(F.lit([0, 1, 2, 3]))).where(
        F.when(way == 0, whole).otherwise(~whole & F.when(n == 1, sign).otherwise(longer))).select(
        *columns, taken.alias("taken"), F.least(way, F.lit(1)).alias("edits"))
    following = states.where("edits = 1").withColumn("first", F.substring("rest", 1, 1)).join(edges, ["node", "first"]).where(whole)
    both = fresh.unionByName(following.select(*columns, n.alias("taken"), F.lit(1).alias("edits")))
    moves = both.select("word", (F.col("position") + F.col("taken")).alias("position"),
                        F.substring(F.col("rest"), F.col("taken") + 1, F.length("rest")).alias("rest"), F.col("child").alias("node"),
                        "edits", "depth", "lengths", "ends", "signs")
    ended = F.when(F.col("edits") == 1, left == 0).otherwise(left == 1)
    # What may still end: an edit spent needs a word of exactly this length and an edge with the next sign.
    able = F.when(F.col("edits") == 0, F.col("signs") != 0).otherwise(
        (left > 0) & (F.col("lengths").bitwiseAND(bit(F.col("depth") + left)) != 0) & (F.col("signs").bitwiseAND(sign_bit(F.col("rest"))) != 0))
    return moves.select("word", "position", "rest", "node", "edits", F.when(ended, F.col("ends")).alias("found"), able.alias("able")).where(
        "able or found is not null")


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: ids of all pairs of words that one edit separates, in both directions."""
    spark = words.sparkSession
    edges, root = fresh_path(spark, "variant-edges"), fresh_path(spark, "variant-states")
    sizes = edge_table(words, edges)
    if not sizes:
        return spark.createDataFrame([], "word long, near long")
    # A word becomes some fifty states at once: its few bytes should not decide how many words a task has.
    dealt = words.repartition(-(-words.count() // WORDS_PER_TASK))
    states = dealt.select(F.col("id").alias("word"), F.lit(0).alias("position"), F.col("word").alias("rest"), "node", F.lit(0).alias("edits"))
    for level, size in enumerate(sizes):
        here = spark.read.schema(EDGES).parquet(f"{edges}/level={level}")
        moved(states, F.broadcast(here) if size <= LEVEL_ROWS else here).write.parquet(f"{root}/{level}")
        written = spark.read.schema(STATES).parquet(f"{root}/{level}")
        written.where("found is not null").select("word", F.col("found").alias("near")).write.mode("append").parquet(f"{root}/found")
        if level:
            delete_path(spark, f"{root}/{level - 1}")
        states = written.where("able").drop("found", "able")
    delete_path(spark, f"{root}/{len(sizes) - 1}")
    delete_path(spark, edges)
    return spark.read.schema("word long, near long").parquet(f"{root}/found")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word on the way along the forms. Pointers double in each round."""
    rows = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    path = None
    while True:
        following = fresh_path(forms.sparkSession, "variant-roots")
        onward = rows.select(F.col("word").alias("at"), F.col("root").alias("onward"))
        rows.join(onward, rows["root"] == onward["at"], "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("open")).write.parquet(following)
        if path:
            delete_path(forms.sparkSession, path)
        path, rows = following, forms.sparkSession.read.schema("word string, root string, open boolean").parquet(following)
        if rows.where("open").isEmpty():
            return rows.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = counted_words(docs)
    named = words.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    best = near_words(words).join(named, "near").groupBy(F.col("word").alias("id")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near_word").alias("word"))).alias("best"))
    frequent = -F.col("best.minus") >= FORM_RATIO * F.col("n")
    judged = materialise(words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n")), "variant-forms")
    rooted = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
codes AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM runs, codes),
results AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
lacking AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM lacking a JOIN lacking b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION SELECT word, part FROM lacking WHERE part IN (SELECT word FROM words)
  UNION SELECT part, word FROM lacking WHERE part IN (SELECT word FROM words)),
best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n
  FROM near JOIN words ON near.other = words.word GROUP BY near.word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form,
    CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, place) AS (
  SELECT word, word FROM judged UNION ALL
  SELECT walk.word, judged.form FROM walk JOIN judged ON walk.place = judged.word WHERE judged.form IS NOT NULL)
SELECT j.word, j.form, w.place AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN walk w ON j.word = w.word JOIN judged e ON w.place = e.word WHERE e.form IS NULL
"""
