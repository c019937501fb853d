"""Every operator on hostile small tables, against plain-Python twins."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.llm import op1_toxicity, op2_mix, op3_pieces, op4_licenses, op5_jaccard_join, op7_warc, op8_line_dedup
from docmill.llm import op10_embedding_dedup, stages
from docmill.llm.common import components
from docmill.llm.op6_exact_dedup import exact_dedup
from docmill.llm.op9_suffix_dedup import multikey_sort, suffix_dedup
from tests.llm import cases
from tests.llm.cases import DOCS, LONG, documents, rows_of


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# --- shared ------------------------------------------------------------------

def test_components(spark):
    random.seed(3)
    edges = [(k, k + 1) for k in range(60)] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(30)]
    edges += [(None, 4), (7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    index = {x: i for i, x in enumerate(nodes)}
    want = cases.grouped(len(nodes), [(index[a], index[b]) for a, b in real])
    assert rows_of(components(df)) == sorted(((nodes[i], nodes[g]) for i, g in enumerate(want)), key=repr)
    assert components(df.limit(0)).count() == 0


# --- 1 -----------------------------------------------------------------------

INSULTS = ("blockhead", "nitwit", "buffoon")


def training(spark, n=400):
    random.seed(5)
    stock = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        w = random.choices(stock, k=30)
        if k % 4 == 0:
            w.insert(random.randrange(30), random.choice(INSULTS))
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, 1, int(k % 4 == 0)))
    return rows, spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_tolerates_gaps(spark):
    rows, labels = training(spark)
    model = op1_toxicity.fit(documents(spark, rows), labels)
    probes = ["you nitwit", "you n.i.t.w.i.t", "you n i t w i t", "you nitxwit", "you buffooon", "shout NITWIT!",
              "hello there friend", "", None, LONG, LONG + " what a blockhead"]
    scored = {r.doc_id: r.predicted for r in op1_toxicity.score(
        documents(spark, [(k, t, "en", "s") for k, t in enumerate(probes)]), model).collect()}
    assert [scored[k] for k in range(len(probes))] == [1] * 6 + [0] * 4 + [1]
    out = op1_toxicity.toxicity(documents(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = op1_toxicity.toxicity(docs, none)
    assert out.count() == len(DOCS) and out.where("predicted = 1").count() == 0
    assert op1_toxicity.toxicity(empty, none).count() == 0
    marked = op1_toxicity.marked(docs.drop("score", "best"), op1_toxicity.fit(docs, none))
    assert marked.where("text is null").count() == 1 and set(docs.columns) <= set(marked.columns) | {"best"}


def test_toxicity_never_reads_other_columns_or_held_out_labels(spark):
    rows, labels = training(spark)
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = documents(spark, rows).withColumn("source", F.lit("other")).withColumn("lang", F.lit(None).cast("string"))
    assert rows_of(op1_toxicity.toxicity(documents(spark, rows), labels)) == rows_of(op1_toxicity.toxicity(moved, flipped))


# --- 2 -----------------------------------------------------------------------

def reshared(sizes, weights, most):
    total, fixed = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = (total - sum(most * sizes[i] for i in fixed)) / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if weights[i] * level > most * sizes[i]}
        if not over:
            return [most * s if i in fixed else weights[i] * level for i, s in enumerate(sizes)]
        fixed |= over


def test_mix_targets_reshare_the_excess(spark):
    random.seed(4)
    for _ in range(4):
        sizes = [random.choice((1, 7, 100, 5000)) for _ in range(9)]
        names = [f"s{k}" for k in range(8)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        got = {r.source: r.target for r in op2_mix.targets(df).collect()}
        want = reshared(sizes, [(5, 2, 1)[k % 3] for k in range(9)], 3)
        assert [got[n] for n in names] == pytest.approx(want)


def test_mix_takes_its_targets(docs, empty):
    out = op2_mix.mix(docs).collect()
    assert len(out) == len(DOCS)
    taken, target = defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"] and (r.position is None) == (r.taken == 0)
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    places = [r.position for r in out if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert rows_of(op2_mix.mix(docs.repartition(5))) == sorted((tuple(r) for r in out), key=repr)
    assert op2_mix.mix(empty).count() == 0


def test_mix_buckets_do_not_change_the_result(docs, monkeypatch):
    before = rows_of(op2_mix.mix(docs))
    monkeypatch.setattr(op2_mix, "ROWS_PER_BUCKET", 1)
    assert rows_of(op2_mix.mix(docs)) == before


def test_schedules_invert(spark):
    for kind, knots in enumerate(op2_mix.SCHEDULES):
        for share in (0.0, 0.1, 0.5, 0.625, 0.9, 0.999):
            t = spark.sql(f"select {op2_mix.position(str(kind), f'CAST({share} AS DOUBLE)')} as t").first().t
            grid = np.linspace(0, t, 20_001)
            weight = np.interp(grid, *zip(*knots))
            assert np.trapezoid(weight, grid) == pytest.approx(share, abs=1e-6)


# --- 3 -----------------------------------------------------------------------

def test_pieces_equal_the_library_and_round_trip(docs, empty):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=op3_pieces.MODEL)
    out = op3_pieces.encode(docs).collect()
    want = [(d, library.encode(t or "")) for d, t, *_ in DOCS]
    assert sorted(((r.doc_id, r.ids) for r in out), key=repr) == sorted(want, key=repr)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in out)
    back = op3_pieces.decode(op3_pieces.encode(docs))
    assert rows_of(back) == sorted(((d, t or "") for d, t, *_ in DOCS), key=repr)
    assert op3_pieces.encode(empty).count() == 0


def test_pieces_on_random_texts():
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=op3_pieces.MODEL)
    machine, memo = op3_pieces.Transducer(op3_pieces.load()), {}
    random.seed(6)
    for _ in range(400):
        text = "".join(random.choice("  \n\n\ttheinganéßж日😀\x00.,!aeio") for _ in range(random.randint(0, 60)))
        assert machine.encode(text, memo) == library.encode(text)


def test_unigram_weights_take_the_least_path():
    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3, value])
        return bytes([number << 3 | 2, len(value)]) + value

    def piece(name, score, kind):
        import struct
        return field(1, field(1, name.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + field(3, kind))
    scores = {"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁a": -3.5, "bab": -9.0}
    model = b"".join([piece("<unk>", 0, 2)] + [piece(f"<0x{k:02X}>", 0, 6) for k in range(256)]
                     + [piece(n, s, 1) for n, s in scores.items()])
    machine = op3_pieces.Transducer(model + field(2, field(3, 1)) + field(3, field(4, 0)))

    def brute(word):
        if not word:
            return 0.0
        return min(-scores[word[:n]] + brute(word[n:]) for n in range(1, 4) if word[:n] in scores)
    for word in ("▁ab", "▁bab", "▁aabab", "▁a"):
        ids = machine.shortest(word)
        assert "".join(machine.names[i] for i in ids) == word
        assert sum(machine.weights[i] for i in ids) == pytest.approx(brute(word))
    assert machine.decode(machine.encode("abé ab", {})) == "abé ab"


# --- 4 -----------------------------------------------------------------------

def base_by_hand(text):
    import re
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, labels = [], set()
    for label, phrase in op4_licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_license_base_columns(spark, docs, empty):
    more = [(100, "Apache License, Version 2.0. apache license version 20; Apache-License version 2", "en", "a"),
            (101, "under the MIT license under the mit-license CC BY-NC 4.0 and cc by nc", "en", "a"),
            (102, "munder the mit license under the mit licenses ünder the mit license", "en", "a"),
            (103, "under the mit license", "en", "a"), (104, "UNDER\x00THE--MIT\nLICENSE!", "en", "a"),
            (105, "under the mit license" + "K" + " under the mIt license", "en", "a")]
    both = docs.unionByName(documents(spark, more))
    out = op4_licenses.scan_licenses(both).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(out) == sorted(((d, *base_by_hand(t)) for d, t, *_ in DOCS + more), key=repr)
    assert op4_licenses.scan_licenses(empty).count() == 0


def test_license_join_equals_brute_force(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = ["filler words here " * 30 + notice + " and more" * 40, notice.replace("hereby ", ""), notice.replace("person", "x").replace("granted", "y"),
             "licensed under the GNU General Public License version 3", "version 3 license public general gnu the under licensed",
             "licensed under the GNU", "words " * 500, "This work is licensed under a Creative Commons Attribution 4.0 International License."]
    out = {r.doc_id: r for r in op4_licenses.scan_licenses(documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])).collect()}
    import re
    for k, text in enumerate(texts):
        words, want = re.findall("[a-z0-9]+", text.lower()), {}
        for label, template in op4_licenses.TEMPLATES:
            t = set(re.findall("[a-z0-9]+", template.lower()))
            span = next(s for s in (8, 16, 32, 64) if s >= len(t))
            share = max(len(t & set(words[i:i + 2 * span])) / len(t) for i in range(0, max(len(words), 1), span))
            if share >= op4_licenses.THRESHOLD - 1e-9:
                want[label] = max(share, want.get(label, 0))
        if not out[k].n_base:
            assert out[k].labels == ",".join(sorted(want)) and out[k].score == pytest.approx(max(want.values(), default=0))


# --- 5 -----------------------------------------------------------------------

@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, docs, empty, words, percent):
    random.seed(7)
    base = [random.choice("abcdefghij") * 3 + str(random.randrange(50)) for _ in range(120)]
    rows = list(DOCS)
    for k in range(60):   # a star of near copies that aren't all near to each other
        w = list(base)
        for _ in range(random.randrange(0, 5)):
            w[random.randrange(120)] = f"edit{random.randrange(1000)}"
        rows.append((200 + k, " ".join(w), "en", "s"))
    df = documents(spark, rows)
    out = op5_jaccard_join.jaccard_components(df, words, percent).drop("twin")
    assert rows_of(out) == cases.jaccard_groups([r[:2] for r in rows], words, percent)
    assert op5_jaccard_join.jaccard_components(empty, words, percent).count() == 0


# --- 6 -----------------------------------------------------------------------

@pytest.mark.parametrize("block", [4, 4096])
def test_exact_dedup(docs, empty, block):
    small = docs.where("text is null or length(text) < 3000") if block == 4 else docs
    rows = [r for r in DOCS if block > 4 or len(r[1] or "") < 3000]
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    out = exact_dedup(small, block).collect()
    assert len(out) == len(rows)
    for d, t, *_ in rows:
        same = groups[t or ""]
        found = [r for r in out if r.doc_id == d and r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()]
        assert found and all(r.group_size == len(same) and r.keep_id == max((x for x in same if x is not None), default=None) for r in found)
    assert sum(r.kept for r in out) == len(groups)
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_dedup_tells_a_common_block_from_a_missing_half(spark, block):
    texts = ["a" * block * n for n in (1, 2, 3, 4, 5, 6, 7, 8, 3)]
    out = exact_dedup(documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), block)
    want = [(k, 8, 2, k == 8) if k in (2, 8) else (k, k, 1, True) for k in range(9)]
    assert rows_of(out.drop("text_sha256")) == sorted(want, key=repr)


# --- 7 -----------------------------------------------------------------------

@pytest.mark.parametrize("chunk", [16, 1 << 18])
def test_warc_round_trip(spark, chunk):
    body = "<html>" + "x" * 200 + "é</html>"
    rows = [(1, "u", body), (2, "u\r\nWARC/1.1", body), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\nWARC/1.1\r\n" * 9),
            (9, "u", "\r\n\r\n" * 60), (10, "u", "é😀" * (2000 if chunk == 16 else 300_000)), (None, "u", body), (1, "u", body),
            (11, "u", "tail\r\n\r\nWARC/1.1"), (12, "u", "x" * 100 + "\r\n"), (13, "http://x/?q=Content-Length: 5", "sixteen bytes..."),
            (14, "Content-Length: 2\r\nContent-Length: 3", "four"), (15, "u", "x" * 16 + "WARC/1.1\r\n" * 30),
            (16, "u", "\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\nabc"), (17, "%0D%25-", "x" * 14 + "\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("record", F.lit(2))
    out = op7_warc.warc_round_trip(pages, chunk)
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in rows:
        data, root = (h or "").encode(), first.get(h)
        again = root is not None and p != root
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", root if again else None))
    assert rows_of(out) == sorted(want, key=repr)
    assert op7_warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_ids_may_hold_header_text(spark):
    body = "y" * 150
    ids = ["a\r\nContent-Length: 3", "Content-Length: 1", "", None, "%0D", "%-", "100%", "b\nWARC-Type: revisit", " spaced "]
    rows = [(p, "u", f"{k} {body}" if k % 2 else body) for k, p in enumerate(ids)]
    out = rows_of(op7_warc.warc_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")))
    first = min(p for k, p in enumerate(ids) if k % 2 == 0 and p is not None)
    assert [r[0] for r in out] == sorted(ids, key=lambda p: repr((p,)))
    for page, size, digest, kind, refers in out:
        html = dict((r[0], r[2]) for r in rows)[page]
        assert (size, digest) == (len(html), hashlib.sha256(html.encode()).hexdigest())
        assert (kind, refers) == (("revisit", first) if html == body and page != first else ("response", None))


def test_warc_chunks_are_bounded(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 5000)], "page_id long, url string, html string")
    chunks = op7_warc.chunk_records(pages, 64).orderBy("chunk_no").collect()
    payloads = [c.record.split("\r\n\r\n", 1)[1] for c in chunks]
    assert "".join(payloads) == "é" * 5000 and max(len(p.encode()) for p in payloads) <= 64
    running = hashlib.sha256()
    for c, p in zip(chunks, payloads):
        running.update(p.encode())
        assert c.payload_sha256 == running.hexdigest()


# --- 8 -----------------------------------------------------------------------

def hashed(spark, lines):
    """SimHashes and blocks of lines, with planes from all of them."""
    liner = op8_line_dedup.Liner()
    found = [liner.lines(x.encode()) for x in lines]
    counts = np.stack([f[5][0] for f in found])
    df = spark.createDataFrame([(c.tobytes(),) for c in counts], "counts binary")
    return np.array([f[3][0] for f in found]), op8_line_dedup.blocks(counts, *op8_line_dedup.planes(df))


def test_line_dedup_equals_brute_force(spark, docs, empty):
    random.seed(8)
    stock = ["".join(random.choice("etaoinshr") for _ in range(random.randint(2, 9))) for _ in range(200)]
    lines = [random.choices(stock, k=random.randint(3, 60)) for _ in range(60)]
    rows = list(DOCS)
    for k in range(120):
        w = list(random.choice(lines))
        for _ in range(random.randrange(0, 3)):
            w[random.randrange(len(w))] = random.choice(stock)
        rows.append((300 + k, "Two words\n" + " ".join(w) + "\n\n" + " ".join(random.choice(lines)).upper(), "en", "s"))
    index, occurrences = {}, []
    for k, (d, t, *_) in enumerate(rows):
        for no, line in enumerate((t or "").split("\n")):
            if n := op8_line_dedup.normal(line):
                index.setdefault(n, len(index))
                occurrences.append(((d is None, d or 0, no), k, no, n))
    names, links = list(index), []
    sims, blocks = hashed(spark, names)
    for i in range(len(names)):
        near = op8_line_dedup.near(sims[:i], sims[i]) & (blocks[:i] == blocks[i]).any(axis=1)
        for j in np.flatnonzero(near).tolist():
            most = max(len(names[i]), len(names[j]))
            limit = int(0.2 * most + 1e-9)
            if abs(len(names[i]) - len(names[j])) <= limit and op8_line_dedup.edit_distance(names[i], names[j], limit) <= limit:
                links.append((i, j))
    assert links
    group, seen, drop = cases.grouped(len(names), links), {}, defaultdict(set)
    for place, k, no, n in sorted(occurrences):
        kept = seen.setdefault(group[index[n]], place)
        if kept != place:
            drop[k].add(no)
    want = []
    for k, (d, t, *_) in enumerate(rows):
        split = (t or "").split("\n")
        want.append((d, "\n".join(x for no, x in enumerate(split) if no not in drop[k]), len(split), len(drop[k])))
    out = op8_line_dedup.line_dedup(documents(spark, rows)).select("doc_id", "text", "n_lines", "n_removed")
    assert rows_of(out) == sorted(want, key=repr)
    assert op8_line_dedup.line_dedup(empty).count() == 0


def changed(line, share=None, letters="etaoinshrdlu"):
    """``line`` with that share of its letters changed, at least and by default one."""
    out, places = list(line), [k for k, c in enumerate(line) if c != " "]
    for k in random.sample(places, max(1, int(len(line) * (share or 0)))):
        out[k] = random.choice(letters)
    return "".join(out)


def meeting(spark, pairs, others=()):
    """Share of pairs of lines that get to the edit distance."""
    sims, blocks = hashed(spark, [x for p in pairs for x in p] + list(others))
    n = 2 * len(pairs)
    met = (blocks[0:n:2] == blocks[1:n:2]).any(axis=1) & op8_line_dedup.near(sims[0:n:2], sims[1:n:2])
    return met.mean()


# more than 2 % of letters changed is beyond the band that the README claims
@pytest.mark.parametrize("share,least", [(None, 0.95), (0.02, 0.9), (0.05, 0.6), (0.1, 0.2)])
def test_line_simhash_recall(spark, share, least):
    random.seed(12)
    stock = ["".join(random.choice("etaoinshrdlucm") for _ in range(random.randint(2, 9))) for _ in range(400)]
    lines = [" ".join(random.choices(stock, k=random.randint(15, 99))) for _ in range(1500)]
    assert meeting(spark, [(x, changed(x, share)) for x in lines]) >= least


def test_line_dedup_drops_lines_with_one_letter_changed(spark):
    random.seed(13)
    stock = ["".join(random.choice("etaoinshr") for _ in range(random.randint(2, 9))) for _ in range(400)]
    lines = [" ".join(random.choices(stock, k=random.randint(10, 60))) for _ in range(60)]
    rows = [(1, "\n".join(lines), "en", "s"), (2, "\n".join(changed(x) for x in lines), "en", "s")]
    (_, none), (_, most) = rows_of(op8_line_dedup.line_dedup(documents(spark, rows)).select("doc_id", "n_removed"))
    assert none == 0 and most >= 54


def test_line_stage_drops_short_and_unspaced_repeats(spark):
    long = "".join(chr(0x4E00 + k * 37 % 9000) for k in range(40))
    rows = [(1, f"Les.\nAnd ornd.\n日本語\n{long}\n--\n--\npage 1", "en", "s"),
            (2, f"les\nand  ornd\n日本語\n{long[:20]}本{long[21:]}\n--\npage 2", "en", "s")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    out = stages.dedup_lines(spark, docs, "").select("doc_id", "text")
    # five of six characters of the last line are equal, which is 0.8 or more
    assert rows_of(out) == [(1, rows[0][1]), (2, "--")]


def test_line_runs_cut_by_partitions_keep_what_one_partition_keeps():
    random.seed(11)
    sims = [random.getrandbits(63) for _ in range(40)]
    sims += [s ^ 1 << 62 for s in sims]
    rows = sorted((7, s, c) for c, s in enumerate(sims))

    def kept(parts):
        out = set()
        for part in parts:
            key, sim, cls = (pa.array(x, pa.int64()) for x in zip(*part))
            chars = pa.array([100] * len(part), pa.int32())
            batch = pa.RecordBatch.from_arrays([key, sim, cls, chars], names=["key", "sim", "class", "chars"])
            for found in op8_line_dedup._runs(op8_line_dedup._close(0.8)[0])(iter([batch])):
                out |= {r["class"] for r in found.to_pylist() if r["key"] is not None}
        return out
    one = kept([rows])
    assert one == set(range(80))
    for n in (3, 7, 20):
        assert kept([rows[k:k + n] for k in range(0, 80, n)]) >= one


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]
    random.seed(9)
    for _ in range(500):
        a, b = ("".join(random.choice("abc") for _ in range(random.randrange(14))) for _ in range(2))
        assert op8_line_dedup.edit_distance(a, b) == plain(a, b)
        for limit in range(8):
            assert (op8_line_dedup.edit_distance(a, b, limit) <= limit) == (plain(a, b) <= limit)


# --- 9 -----------------------------------------------------------------------

def test_suffix_dedup_equals_brute_force(spark, docs, empty):
    random.seed(10)
    passages = ["".join(random.choice("abcdef ") for _ in range(n)) for n in (199, 200, 201, 350, 900)]
    rows = [r for r in DOCS if len(r[1] or "") < 5000]
    for k in range(40):
        noise = ["".join(random.choice("uvwxyz ") for _ in range(random.randrange(300))) for _ in range(4)]
        rows.append((400 + k, "".join(x + random.choice(passages)[random.randrange(3):] for x in noise), "en", "s"))
    data, spans = cases.repeated_spans([t for _, t, *_ in rows])
    want = []
    for (d, *_), raw, cut in zip(rows, data, spans):
        rest, at = b"", 0
        for begin, end in cut:
            rest, at = rest + raw[at:begin], end
        want.append((d, len(raw), sum(e - b for b, e in cut), len(cut), hashlib.sha256(rest + raw[at:]).hexdigest()))
    assert rows_of(suffix_dedup(documents(spark, rows))) == sorted(want, key=repr)
    assert suffix_dedup(empty).count() == 0


def test_suffix_dedup_long_texts(docs):
    out = {r.doc_id: r for r in suffix_dedup(docs.where("doc_id in (6, 12)"), texts=True).collect()}
    assert out[12].n_removed == 120_000 and out[12].kept == b" changed" and out[6].n_spans == 2


def test_multikey_sort():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 3, 500), rng.integers(-5, 5, 500)
    order = multikey_sort(a, b)
    assert list(zip(a[order], b[order])) == sorted(zip(a.tolist(), b.tolist()))


# --- 10 ----------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("x")).withColumn("n", F.lit(1))


@pytest.mark.parametrize("block", [7, 2048])
def test_embedding_dedup_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    rows = [(k, (centers[k % 40 if k % 3 else 0] + rng.normal(size=16) * 0.05).tolist(), 0) for k in range(300)]
    rows += [(300, rows[1][1], 1), (301, [x * 4 for x in rows[1][1]], 2), (1, rows[1][1], None), (None, rows[1][1], 1),
             (302, None, 1), (303, [], 1), (304, [0.0] * 16, 1), (305, [float("nan")] + [1.0] * 15, 1),
             (306, [float("inf")] + [1.0] * 15, 1), (307, [None] + [1.0] * 15, 1), (308, [1.0, 2.0], 1), (309, [1.0, 2.1], 1)]
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    unit = [np.float64(np.float32(v)) / np.linalg.norm(np.float64(np.float32(v))) if g else None for (_, v, _), g in zip(rows, good)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if good[i] and good[j]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    group, degree = cases.grouped(len(rows), links), defaultdict(int)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    want = []
    for i, (v, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        root = min(ids) if ids else None
        want.append((v, degree[i], root, v == root))
    out = op10_embedding_dedup.embedding_dedup(vectors(spark, rows), leaf_rows=64, block=block)
    assert rows_of(out) == sorted(want, key=repr)


def test_embedding_dedup_recall_and_empty(spark):
    """Pairs right at the threshold, in small leaves: at least 0.9 are found."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * side
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([a, b]))]
    out = op10_embedding_dedup.embedding_dedup(vectors(spark, rows), leaf_rows=32)
    assert out.where("n_links > 0").count() >= 0.9 * 3000
    assert op10_embedding_dedup.embedding_dedup(vectors(spark, rows).limit(0)).count() == 0
