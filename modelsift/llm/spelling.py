"""Spelling variants: a relational trie frontier finds all pairs of words one inserted, deleted or replaced code point apart.

A trie of the vocabulary is a table of edges ``(node, label, child)``; a node is the digest of a prefix and unbranched chains are one
edge.  States ``(word, position, node, edits)`` are joined with the edges level by level.  A pair differs first where its longest
common prefix ends, so a state spends its edit only on an edge that leaves its own path, and then must match to the end of both.
Words run through a trie of the words and one of the reversed words, and in each the edit lies in the second half only: of two
words one edit apart, the common prefix or the common suffix holds at least half.  So no state fans out near the root, where all words
meet.  Nodes with many words have their edges in several salted copies and states pick one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LETTERS = "[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY = 5_000  # words of a node that one salted copy of its edges serves
WAYS = (b"forward", b"back")


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, noise: int = 97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the distinct runs of letters, A-Z lower-cased, of at least so many code points and occurrences in all texts.

    With h the crc32 of ``key:run``, a run loses its code point h % length where ``noise`` divides h.  A null text has no runs, a
    null key counts as the empty string, rows that repeat a key count each.
    """
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(LETTERS), 0)).alias("run"))
    length = F.length("run")
    h = F.crc32(F.concat("k", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % length).cast("int")
    worn = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    words = runs.where(length >= least_length).withColumn("h", h).select(F.when(F.col("h") % noise == 0, worn).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each word: its digest, and position, prefix digest, next letter and code points left of its second half, a
    row each."""
    names = ["wid", "pos", "node", "letter", "left"]

    def rows(wids: list, places: list, nodes: list, letters: list, left: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(wids, pa.binary()), pa.array(places, pa.int32()), pa.array(nodes, pa.binary()), pa.array(letters, pa.string()), pa.array(left, pa.int32())], names=names)

    for batch in batches:
        held: tuple[list, ...] = ([], [], [], [], [])
        for word in batch.column(0).to_pylist():
            for way in WAYS:
                s = word if way == WAYS[0] else word[::-1]
                at = max(0, (len(s) - 1) // 2)  # the first p with 2 p >= len - 2
                h = hashlib.blake2b(s[:at].encode(), digest_size=16, person=way)
                own = []
                for p in range(at, len(s)):
                    own.append(h.copy().digest())
                    h.update(s[p].encode())
                own.append(h.digest())
                for column, values in zip(held, ([own[-1]] * len(own), range(at, len(s) + 1), own, [*s[at:], ""], range(len(s) - at, -1, -1))):
                    column += values
                if len(held[0]) > 50_000:
                    yield rows(*held)
                    held = ([], [], [], [], [])
        if held[0]:
            yield rows(*held)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        for way in WAYS:
            run = words if way == WAYS[0] else [w[::-1] for w in words]
            yield pa.record_batch([pa.array([hashlib.blake2b(s.encode(), digest_size=16, person=way).digest() for s in run], pa.binary()), pa.array(run, pa.string()), batch.column(0), pa.array([way == WAYS[1]] * len(run))], names=["wid", "s", "word", "back"])


def _piece(column: str, start: Column | str, length: Column | str) -> Column:
    """``length`` code points of a text from position ``start`` (from 0)."""
    return F.substring(F.col(column), (F.col(start) if isinstance(start, str) else start) + 1, F.col(length) if isinstance(length, str) else length)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(names, edges, starts)`` of the tries of ``words`` (column ``word``, distinct) in both directions.

    names: ``wid, s, word, back``.  edges: ``node, salt, first, rest, child, child_salts`` (a label in two parts; 0 salts: a leaf),
    what can follow the child (``lengths``, ``letters``), and ``ends`` where the child is a word.  starts: ``s, pos, node, salt, edits`` at the first branch in the second half of each word, no edit spent.
    """
    letters = common.settled(words.select("word").mapInArrow(_prefixes, "wid binary, pos int, node binary, letter string, left int"), "letters", compression="zstd")
    names = common.settled(words.select("word").mapInArrow(_ids, "wid binary, s string, word string, back boolean"), "names", compression="zstd")
    steps = letters.groupBy("node", "letter").agg(F.count(F.lit(1)).alias("words"), F.bit_or(_bit("left")).alias("lengths"))
    kept = steps.groupBy("node").agg(F.count(F.lit(1)).alias("ways"), F.sum("words").alias("words"), F.bit_or("lengths").alias("lengths"), F.bit_or(_bit(F.ascii("letter"))).alias("letters")).where("ways > 1")
    kept = kept.select("node", F.ceil(F.col("words") / HEAVY).cast("int").alias("salts"), "lengths", "letters")
    paths = letters.drop("letter", "left").join(kept, "node").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "salts", "lengths", "letters"))).alias("path"))
    paths = common.settled(paths.join(names.select("wid", "s"), "wid"), "paths", compression="zstd")

    each = paths.select("wid", "s", "path", F.posexplode("path").alias("i", "here"))
    each = each.select("wid", "s", "here", F.get("path", F.col("i") + 1).alias("there"))
    stop = F.coalesce(F.col("there.pos"), F.length("s"))
    hops = each.select(
        F.col("here.node").alias("node"), F.col("here.salts").alias("salts"), _piece("s", F.col("here.pos"), stop - F.col("here.pos")).alias("label"),
        F.coalesce("there.node", "wid").alias("child"), F.coalesce("there.salts", F.lit(0)).alias("child_salts"), (stop == F.length("s")).alias("ends"),
        F.coalesce("there.lengths", F.lit(0)).alias("lengths"), F.coalesce("there.letters", F.lit(0)).alias("letters"),
    ).where("label <> ''")
    edges = hops.groupBy("node", "salts", "label", "child", "child_salts", "lengths", "letters").agg(F.max("ends").alias("ends"))
    edges = edges.select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.substring("label", 1, 1).alias("first"), F.expr("substring(label, 2)").alias("rest"), "child", "child_salts", "lengths", "letters", "ends")
    edges = edges.repartition(common.partitions(words.sparkSession), "node", "salt").sortWithinPartitions("node", "salt")
    half = F.filter("path", lambda p: p["pos"] * 2 >= F.length("s") - 1)
    starts = paths.select("s", F.get(half, F.lit(0)).alias("p")).where("p is not null")
    starts = starts.select("s", F.col("p.pos").alias("pos"), F.col("p.node").alias("node"), _salt("s", F.col("p.salts")), F.lit(0).alias("edits"))
    return names, edges, starts


def _bit(number: Column | str) -> Column:
    """A 64-bit set of one number, modulo 64."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(number) if isinstance(number, str) else number, F.lit(64)).cast("int"))


def _salt(word: str, salts: Column) -> Column:
    return F.pmod(F.crc32(F.col(word).cast("binary")), F.greatest(salts, F.lit(1))).cast("int").alias("salt")


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one edge further: along their own path, or off it by the one edit."""
    here = states.withColumn("next", _piece("s", "pos", F.lit(1)))
    met = here.join(edges, ["node", "salt"]).where((F.col("first") == F.col("next")) | (F.col("edits") == 0))
    size, own = F.length("rest"), F.col("first") == F.col("next")
    after_next, from_next = F.col("rest") == _piece("s", F.col("pos") + 1, size), F.col("rest") == _piece("s", "pos", size)
    moves = F.array(  # along an equal letter, or with the letter replaced by a greater one; with a letter added
        F.when(after_next & (own | ((F.col("next") != "") & (F.col("first") > F.col("next")))), F.struct((F.col("pos") + 1 + size).alias("pos"), F.when(own, F.col("edits")).otherwise(1).alias("edits"))),
        F.when(from_next & ~own, F.struct((F.col("pos") + size).alias("pos"), F.lit(1).alias("edits"))),
    )
    met = met.select("s", "child", "child_salts", "lengths", "letters", "ends", F.explode(moves).alias("to")).where("to is not null")
    left = F.length("s") - F.col("to.pos")
    found = (F.col("to.edits") == 1) & (left == 0) & F.col("ends")
    follows = (F.col("lengths").bitwiseAND(_bit(left)) != 0) & (F.col("letters").bitwiseAND(_bit(F.ascii(_piece("s", "to.pos", F.lit(1))))) != 0)
    goes = (F.col("child_salts") > 0) & F.when(F.col("to.edits") == 1, (left > 0) & follows).otherwise(F.lit(True))
    return met.where(found | goes).select("s", F.col("to.pos").alias("pos"), F.col("child").alias("node"), _salt("s", F.col("child_salts")), F.col("to.edits").alias("edits"), found.alias("found"))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near`` in both orders for all pairs of ``words`` (column ``word``) exactly one inserted, deleted or replaced code point
    apart.  Null words have none, repeated words count once, the empty word is near every word of one code point."""
    spark = words.sparkSession
    distinct = common.settled(words.select("word").where("word is not null").distinct(), "words")
    names, edges, states = trie(distinct)
    edges = edges.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = []
        while True:  # one level of branches a round; as many rounds as branches lie on the longest path through a second half
            after = common.settled(_step(states, edges), "frontier", compression="zstd")
            if after.isEmpty():
                break
            found.append(after.where("found").select("s", "node"))
            states = after.where("not found").drop("found")
        pairs = spark.createDataFrame([], "s string, node binary")
        for part in found:
            pairs = pairs.unionAll(part)
        other = names.select(F.col("wid").alias("node"), "back", F.col("word").alias("near"))
        pairs = pairs.join(other, "node").select(F.when(F.col("back"), F.reverse("s")).otherwise(F.col("s")).alias("word"), "near")
        pairs = common.settled(pairs.distinct(), "near")
    finally:
        edges.unpersist()
    return pairs.unionAll(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n``: a word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``ratio`` times its own; root follows forms to the last."""
    known = common.settled(words.select("word", "n"), "vocabulary")
    near = neighbours(known).join(known.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    table = known.join(best, "word", "left").withColumn("top", -F.col("best.minus"))
    formed = F.col("top") >= ratio * F.col("n")
    table = common.settled(table.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("top")).alias("form_n")), "forms")

    links = table.where("form is not null").select("word", F.col("form").alias("root"))
    links = common.settled(links, "roots")  # n at least doubles from link to link, so doubling the links ends after log log n rounds
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("above"))
        after = common.settled(links.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        links = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return table.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc32_sql(text: str) -> str:
    """crc32 of a text in DuckDB: eight shift steps a byte, over its UTF-8 bytes."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    byte = "list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: " + step + ")"
    data = f"list_transform(range(cast(length(hex(encode({text}))) / 2 as bigint)), lambda i: cast(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) as bigint))"
    return f"xor(list_reduce([4294967295::bigint] || {data}, lambda a, b: {byte}), 4294967295)"


SQL = rf"""with recursive runs as (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') as run from documents),
counted as (select doc_id, run, count(*) as times from runs where length(run) >= 5 group by all),
hashed as (select *, {_crc32_sql("(doc_id || ':' || run)")} as h from counted),
worn as (select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, times from hashed),
words as materialized (select word, cast(sum(times) as bigint) as n from worn where length(word) >= 5 group by word having sum(times) >= 3),
cuts as (select word, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as (
    select distinct word, near from (
        select x.word, y.word as near from cuts x join cuts y using (i, a, b) where x.word <> y.word
        union all select x.word, y.word from cuts x join words y on x.a || x.b = y.word
        union all select y.word, x.word from cuts x join words y on x.a || x.b = y.word)),
best as (select near.word, count(*) as n_near, min(struct_pack(minus := -w.n, near := near.near)) as best from near join words w on near.near = w.word group by near.word),
forms as materialized (select words.word, n, coalesce(n_near, 0) as n_near, case when -best.minus >= 2 * n then best.near end as form, case when -best.minus >= 2 * n then -best.minus end as form_n
    from words left join best using (word)),
climb as (select word, form as root from forms where form is not null
    union all select climb.word, forms.form from climb join forms on climb.root = forms.word where forms.form is not null),
tops as (select climb.word, climb.root from climb join forms on climb.root = forms.word where forms.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from forms left join tops using (word)"""


@common.query("op11_trie_variants", SQL)
def op11_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(common.table(spark, sf_dir, "documents")))
