"""Phrase collocation mining: phrases of two to five words that stand together.

Counting is by top-order marginalisation. Only the longest windows are counted: the
word at a place and, as lead columns, the up to four words after it, padded where the
piece ends. ``ROLLUP`` over the columns then sums windows to ever shorter prefixes,
and a prefix of k words that is not padded is a phrase of k words with all its
occurrences. No n-gram of another length is ever formed.

As a piece lies in one row, the lead columns are shifted arrays inside the row and
nothing is shuffled before the windows. A window is also padded where no candidate
can go on, which is exact, since every part of a frequent phrase is frequent: before
a rare word and between two words that are rarely neighbours. Both are looked up in
bit tables of fixed size; a false hit makes a window longer than it need be and
changes no count.

Windows hold 64-bit names of words. A word table, counted exactly by the word's text,
spells the phrases at the end and proves that no frequent word shares its name;
otherwise all is named anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docmill.llm.common import store
from docmill.llm.op9_suffix_dedup import BASE, _powers, mixed
from docmill.session import broadcast_if_small

MOST_WORDS, LEAST_COUNT, PER_LANG = 5, 100, 2000
PIECE = 1 << 20              # bytes of text handled at once; ends at a blank or a break
HELD = 1 << 22               # pairs of words summed inside a task before they leave it
SALTS = (1 << 10, 1 << 5)    # parts of a language that are ranked apart first
FILTER_BITS = 27             # bits of a filter: 16 MB, whatever the input
SLICES = 64
BASE2 = 0xD1342543DE82EF95


class Lexer:
    """Names of the words of a text and the pieces that they stand in."""

    def __init__(self, salt: int = 0):
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.values = np.random.default_rng(13 + salt).integers(1, 1 << 63, 256, dtype=np.uint64)[fold] | np.uint64(1)
        self.kind = np.zeros(256, np.uint8)
        self.kind[[32, 9]] = 1
        self.kind[[*b".,;:!?", *range(10, 14)]] = 2
        self.limit = 0

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """``start, end, piece`` of the words; pieces are numbered by the breaks before."""
        kind = self.kind[data]
        edge = np.diff((kind == 0).astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return start, end, np.searchsorted(np.flatnonzero(kind == 2), start)

    def names(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
        """Names of words, never 0."""
        if len(data) > self.limit:
            self.limit = 2 * len(data)
            self.up = {b: _powers(b, self.limit) for b in (BASE, BASE2)}
            self.down = {b: _powers(pow(b, -1, 1 << 64), self.limit) for b in (BASE, BASE2)}
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[base][:len(data)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[base][start] + (end - start).astype(np.uint64)) | np.uint64(1)

    def segments(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Texts of a batch ``lang, text`` as ``data, langs, ends, goes_on``.

        Short texts come many at a time, with a break after each: ``langs`` and
        ``ends`` tell whose bytes are whose. A long one comes in parts that end at a
        blank or a break; ``goes_on`` says that the next part is of the same text.
        """
        held, langs, size = [], [], 0

        def joined():
            ends = np.cumsum([len(x) + 1 for x in held])
            return np.frombuffer(b"\n".join(held) + b"\n", np.uint8), langs, ends, False

        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = memoryview(text.as_buffer())
            if len(raw) <= PIECE:
                held.append(raw)
                langs.append(lang)
                size += len(raw)
                if size > PIECE:
                    yield joined()
                    held, langs, size = [], [], 0
                continue
            data, at = np.frombuffer(raw, np.uint8), 0
            while at < len(data):
                end = min(at + PIECE, len(data))
                while end < len(data) and not self.kind[data[end - 1]]:
                    end += 1
                yield data[at:end], [lang], np.array([end - at]), end < len(data)
                at = end
        if held:
            yield joined()


def _merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sum the counts of equal rows. Rows are sorted by a fingerprint, and neighbours
    are compared in all columns: a collision leaves two groups, which add up later."""
    key = np.zeros(len(counts), np.uint64)
    for c in columns:
        key = mixed(key * np.uint64(BASE) + c.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    change = np.zeros(len(order), bool)
    if len(order):
        change[0] = True
    for c in columns:
        c = c[order]
        change[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(change)
    at = order[first]
    return [c[at] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0], at


def _words(salt: int):
    """``lang, text`` to ``lang, word, name, n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(salt)
        for batch in batches:
            for data, langs, ends, _ in lexer.segments(batch):
                start, end, _ = lexer.spans(data)
                code: dict[str, int] = {}
                of = np.array([code.setdefault(x, len(code)) for x in langs], np.int64)
                lang = of[np.searchsorted(ends, start, side="right")]
                columns = [lang, lexer.names(data, start, end), lexer.names(data, start, end, BASE2)]
                (lang, name, _), n, at = _merged(columns, np.ones(len(start), np.int64))
                raw = data.tobytes()
                texts = [raw[a:b].lower() for a, b in zip(start[at].tolist(), end[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(code), pa.string()).take(pa.array(lang)),
                     pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                     pa.array(name.view(np.int64)), pa.array(n)], names=["lang", "word", "name", "n"])
    return run


def _neighbours(langs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(langs + left * np.uint64(BASE)) + right)


def _lang_names(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in langs], np.uint64)


class BitTable:
    """Which names a fixed table of bits may hold."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def has(self, names: np.ndarray) -> np.ndarray:
        place = mixed(names) >> self.shift
        return self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1


def _bit_slices(width: int):
    """Rows ``slice, place``, sorted by slice, to ``slice, bits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                names=["slice", "bits"])

        for batch in batches:
            which, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(which):
                if k != now:
                    if now is not None:
                        yield row()
                    now, bits = k, np.zeros(width, bool)
                bits[place[which == k]] = True
        if now is not None:
            yield row()
    return run


def bit_table(names: DataFrame, bits: int = FILTER_BITS) -> BitTable:
    """The table of ``names (name long)``; built in slices, and as large as ``bits`` says."""
    width = (1 << bits) // SLICES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (mixed(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((place // width).astype(np.int32)), pa.array((place % width).astype(np.int32))],
                names=["slice", "place"])

    rows = (names.mapInArrow(places, "slice int, place int").repartition("slice").sortWithinPartitions("slice")
            .mapInArrow(_bit_slices(width), "slice int, bits binary").collect())
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        table[r.slice * width // 8:(r.slice + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return BitTable(table)


def _walk(lexer: Lexer, batch: pa.RecordBatch, lead: int) -> Iterator[tuple]:
    """``names, piece, lang code, codes, ready``: words in order. Windows that start
    before ``ready`` are whole; the words after it come again with the next part."""
    kept, base = None, 0
    for data, langs, ends, goes_on in lexer.segments(batch):
        start, end, piece = lexer.spans(data)
        names = lexer.names(data, start, end)
        code: dict[str, int] = {}
        of = np.array([code.setdefault(x, len(code)) for x in langs], np.int64)
        lang = of[np.searchsorted(ends, start, side="right")]
        piece = piece + base
        if kept is not None:
            names, piece = np.concatenate([kept[0], names]), np.concatenate([kept[1], piece])
            lang = np.zeros(len(names), np.int64)
        ready = max(len(names) - lead, 0) if goes_on else len(names)
        kept = (names[ready:], piece[ready:]) if goes_on else None
        base = base + int((lexer.kind[data] == 2).sum()) if goes_on else 0
        yield names, piece, lang, list(code), ready


def _pairs(words):
    """``lang, text`` to ``pair, n``: neighbours that are both frequent words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, table = words.value
        lexer, held, size = Lexer(salt), [], 0

        def emit():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for names, piece, lang, langs, ready in _walk(lexer, batch, 1):
                some = table.has(names)
                at = np.flatnonzero(some[:-1] & some[1:] & (piece[1:] == piece[:-1]))
                at = at[at < ready]
                held.append(_neighbours(_lang_names(langs)[lang[at]], names[at], names[at + 1]))
                size += len(at)
                if size > HELD:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()
    return run


def _windows(most: int, tables):
    """``lang, text`` to ``lang, w1 .. w<most>``: padded longest windows of two words or
    more, a row for each place; Spark's partial aggregation adds them up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, table, pairs = tables.value
        lexer = Lexer(salt)
        for batch in batches:
            for names, piece, lang, langs, ready in _walk(lexer, batch, most - 1):
                some = table.has(names)
                on = np.zeros(len(names), bool)
                near = np.flatnonzero(some[:-1] & some[1:] & (piece[1:] == piece[:-1]))
                on[near] = pairs.has(_neighbours(_lang_names(langs)[lang[near]], names[near], names[near + 1]))
                at = np.flatnonzero(on[:ready])
                if not len(at):
                    continue
                columns, alive = [names[at]], np.ones(len(at), bool)
                for k in range(1, most):
                    place = np.minimum(at + k, len(names) - 1)      # the lead column, or the pad
                    alive = alive & on[place - 1] & (at + k < len(names))
                    columns.append(np.where(alive, names[place], np.uint64(0)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()).take(pa.array(lang[at])), *(pa.array(c.view(np.int64)) for c in columns)],
                    names=["lang", *(f"w{k + 1}" for k in range(most))])
    return run


def _named_words(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """The stored word table and the salt under which names of frequent words are their own."""
    for salt in range(8):
        words = store(rows.mapInArrow(_words(salt), "lang string, word string, name long, n long")
                      .groupBy("lang", "word").agg(F.any_value("name").alias("name"), F.sum("n").alias("n")), "phrase-words")
        shared = words.groupBy("name").agg(F.min("word").alias("a"), F.max("word").alias("b"), F.max("n").alias("n"))
        if shared.where((F.col("a") != F.col("b")) & (F.col("n") >= least)).isEmpty():
            return words, salt
    raise ValueError("frequent words share their names under every salt")


def phrase_counts(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT,
                  filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, key array<long>, n`` of all phrases with at least ``least`` occurrences, single
    words too, and the word table ``lang, word, name, n``."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, salt = _named_words(rows, least)
    frequent = words.where(F.col("n") >= least)
    table = bit_table(frequent.select("name").distinct(), filter_bits)
    shipped = [context.broadcast((salt, table))]
    pairs = rows.mapInArrow(_pairs(shipped[0]), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    near = bit_table(pairs.where(F.col("n") >= least).select("pair"), filter_bits)
    shipped.append(context.broadcast((salt, table, near)))
    columns = [f"w{k + 1}" for k in range(most)]
    windows = rows.mapInArrow(_windows(most, shipped[1]), ", ".join(["lang string", *(f"{c} long" for c in columns)]))
    # one head of language and first pair spares ROLLUP the levels that no phrase has
    head = F.struct("lang", "w1", "w2").alias("head")
    rolled = windows.select(head, *columns[2:]).rollup("head", *columns[2:]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    # level 2^k - 1: the last k columns are summed over
    last = F.lit(None).cast("long")
    key = F.lit(None).cast("array<long>")
    for k in range(2, most + 1):
        whole = F.col("level") == (1 << most - k) - 1
        names = [F.col("head.w1"), F.col("head.w2"), *(F.col(c) for c in columns[2:k])]
        last, key = F.when(whole, names[-1]).otherwise(last), F.when(whole, F.array(*names)).otherwise(key)
    phrases = rolled.where(F.col("n") >= least).select("head.lang", key.alias("key"), last.alias("last"), "n").where(
        "key is not null and last <> 0").drop("last")
    singles = frequent.select("lang", F.array("name").alias("key"), "n")
    counts = store(phrases.unionByName(singles), "phrase-counts")
    for b in shipped:
        b.destroy()
    return counts, words


# floor(1000 a n / (l r)), in decimals of up to 38 digits; 0.0 < quotient < 2^63
SCORE = ("(cast(a as decimal(16,0)) * 1000BD * cast(n as decimal(18,0))) div "
         "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT,
                 per_lang: int = PER_LANG, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``, the first ``per_lang`` of each language.

    ``a``, ``l`` and ``r`` count the phrase and both parts of its weakest cut, ``n``
    all words of the language. A phrase inside a longer one as frequent as itself is
    left out. A null language is ``und``, a null text is empty; equal rows count as
    often as they stand; other columns are ignored; no frequent phrase, no rows.
    """
    counts, words = phrase_counts(docs, most, least, filter_bits)
    phrases = counts.where("size(key) > 1").withColumnRenamed("n", "a")
    # Each occurrence of a phrase is one of every phrase inside it. So counts never
    # grow with length, and a longer phrase with the same count reaches down through
    # phrases one word shorter: those are all that must be looked at.
    inner = phrases.where("size(key) > 2").select(
        "lang", F.explode(F.expr("array(slice(key, 1, size(key) - 1), slice(key, 2, size(key) - 1))")).alias("key"), "a")
    covered = inner.groupBy("lang", "key").agg(F.max("a").alias("a"))
    kept = phrases.join(covered, ["lang", "key", "a"], "left_anti")
    parts = counts.select("lang", F.col("key").alias("part"), F.col("n").alias("f"))
    cuts = kept.select("lang", "key", "a", F.explode(F.expr("sequence(1, size(key) - 1)")).alias("cut"))
    for side, piece in (("l", "slice(key, 1, cut)"), ("r", "slice(key, cut + 1, size(key))")):
        cuts = cuts.withColumn("part", F.expr(piece)).join(
            parts.withColumnRenamed("f", side), ["lang", "part"]).drop("part")
    totals = broadcast_if_small(words.groupBy("lang").agg(F.sum("n").alias("n")))
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(SCORE)).groupBy("lang", "key").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("low"), F.first("a").alias("a"), F.first("n").alias("n"))
    spelled = (
        scored.select("lang", "key", "a", "n", "low", F.posexplode("key").alias("pos", "name"))
        .join(broadcast_if_small(words.where(F.col("n") >= least).select("lang", "name", "word")), ["lang", "name"])
        .groupBy("lang", "key").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"),
            *(F.first(c).alias(c) for c in ("a", "n", "low"))))
    order = [F.desc("low.score"), F.desc("a"), F.asc("phrase")]
    ranked = spelled
    for parts in (*SALTS, 1):     # the best of each part, of parts together, then of the language
        best = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_lang)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")
