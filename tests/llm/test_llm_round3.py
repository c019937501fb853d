"""Personal data, prefix trie and collocations against plain-Python twins."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import op11_pii, op12_prefix_trie, op13_collocations
from docmill.llm.op11_pii import all_spans, disguised, personal_data, span_digest, spans
from docmill.llm.op12_prefix_trie import prefix_trie, walk
from docmill.llm.op13_collocations import BitTable, Lexer, bit_table, collocations, phrase_counts
from docmill.llm.queries import QUERIES
from tests.llm.cases import CLASHES, DOCS, documents, rows_of

# --- 11 ----------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])) % 10 == 0


def base_twin(text):
    def number(m):
        return "".join(re.findall("[0-9]", m[0]))
    tests = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
             ("card", CARD, lambda m: 14 <= len(number(m)) <= 19 and plain_luhn(number(m))),
             ("phone", PHONE, lambda m: 10 <= len(number(m)) <= 15))
    found = [(kind, *m.span()) for kind, pattern, good in tests for m in re.finditer(pattern, text) if good(m)]
    order = [t[0] for t in tests]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def card(prefix, n=16):
    body = prefix + "7" * (n - 1 - len(prefix))
    return body + next(str(d) for d in range(10) if plain_luhn(body + str(d)))


MESSY = [
    "", "a@b.c", "@b.c", "x@@y.z.", "a@b..c", "a@b.c@d.e.f", "a.b+c%d@e-f.g-h.i_j", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255x",
    "1.2.3", card("4111"), card("51", 19), card("3", 14) + "0", card("4") + " " + card("5"), "+1 (234) 567.89-01", "+1234567890", "++12345678901-",
    "+123456789012345 6", "+1" + "2" * 400, "9" * 3000, "1." * 2000, "a" * 3000 + "@" + "b." * 900, "+" * 2000, "é+33 1 23 45 67 89😀x@y.zz",
]


def test_base_spans_equal_the_patterns():
    random.seed(11)
    pool = ["@", ".", "+", "-", " ", "(", ")", "a", "Z", "é", "😀", "1", "23", "255", "256", card("4"), "x@y.z", "\n", "%", "_"]
    texts = MESSY + ["".join(random.choices(pool, k=random.randrange(60))) for _ in range(3000)]
    for text in texts:
        assert spans(text) == base_twin(text), text
        found = all_spans(text)
        assert [s[:3] for s in found if not s[3]] == base_twin(text)


@pytest.mark.parametrize("kind, hidden, before, after", [
    ("email", "john [at] example [dot] com", "write to ", " soon"),
    ("email", "john (at) example.co (dot) uk", "", "!"),
    ("email", "jane dot doe at mail dot example dot org", "reach ", " please"),
    ("email", "jоhn@еxample.com", "", ""),
    ("email", "user＠host．org", "(", ")"),
    ("email", "john@exam­ple.com", "\U0001f600 ", ""),
    ("phone", "plus four nine one seven two five five five zero one two three", "call ", ""),
    ("phone", "+33 1 23 45 67 89", "Tél. ", "."),
    ("ip", "one nine two dot one six eight dot one dot one", "host ", ","),
    ("ip", "١٢.1.2.3", "", ""),
    ("card", "4111‐1111‐1111‐1111", "", ""),
    ("card", "four one one one, one one one one, one one one one, one one one one", "", ""),
    ("card", "4l11 1111 1111 1111", "", ""),
])
def test_disguises_map_back_to_the_source(kind, hidden, before, after):
    text = before + hidden + after
    found = [s for s in all_spans(text) if s[3]]
    assert (kind, len(before), len(before) + len(hidden), True) in found and {s[0] for s in found} == {kind}


@pytest.mark.parametrize("text", [
    "we look at the dot com boom", "one two three four five six", "1990–1995 and 2001–2002", "meet at noon", "a [at] b", "x (dot) y",
    "в годах слово.Она", "l1l1 0O0O", "one, two. three",
])
def test_plain_prose_holds_nothing(text):
    assert all_spans(text) == []


def test_edits_compose_like_arrays_of_offsets():
    random.seed(12)
    pool = list("ab1 ") + ["а", "​", " dot ", "[at]", "one ", "two-", "O", "＠", ", ", "plus "]
    for _ in range(2000):
        now = source = "".join(random.choices(pool, k=30))
        last, low, high, touched = None, list(range(len(now))), list(range(1, len(now) + 1)), [False] * len(now)
        for transducer in op11_pii.TRANSDUCERS:
            edits = list(transducer(now))
            if not edits:
                continue
            new = [[], [], []]
            at = 0
            for start, end, text in [*edits, (len(now), len(now), "")]:
                for column, old in zip(new, (low, high, touched)):
                    column += old[at:start]
                new[0] += [low[start]] * len(text) if text else []
                new[1] += [high[end - 1]] * len(text) if text else []
                new[2] += [True] * len(text)
                at = end
            last = op11_pii.Rewritten(now, edits, last)
            now, (low, high, touched) = last.text, new
        if last is None:
            continue
        assert len(low) == len(now)
        for _ in range(10):
            a = random.randrange(len(now)) if now else 0
            b = random.randrange(a + 1, len(now) + 1) if now else 0
            if now:
                left, right, edited = last.back(a, b)
                assert (left, right) == (low[a], high[b - 1])
                assert edited or not any(touched[a:b])


def test_spans_of_hostile_rows(spark):
    rows = DOCS + [(20 + k, t, None, None) for k, t in enumerate(MESSY)] + [(20, "twice a@b.c", "en", "a"), (20, "twice a@b.c", "en", "a")]
    docs = documents(spark, rows)
    got = rows_of(span_digest(personal_data(docs)))
    want = []
    for doc, text, _, _ in rows:
        base, found = base_twin(text or ""), all_spans(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = Counter(k for k, _, _ in base)
        want.append((doc, *(counts[k] for k in op11_pii.KINDS), hashlib.sha256(listed.encode()).hexdigest(),
                     ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)))
    assert got == sorted(want, key=repr)
    assert span_digest(personal_data(documents(spark, []))).collect() == []


def test_registered_personal_data_equals_the_patterns(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_pii"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = base_twin(docs[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        counts = Counter(k for k, _, _ in base)
        assert tuple(r)[1:5] == tuple(counts[k] for k in op11_pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
    assert any(r.n_email for r in rows) and not any(disguised(t) for t in docs.values())


def test_long_texts_take_linear_time():
    for unit in ("1", "1.", "a", "a@", "+", "(at) ", "one ", " at x dot ", "о", "- ", "9 9-", "[", "4l"):
        all_spans(unit * (300_000 // len(unit)))


# --- 12 ----------------------------------------------------------------------

def trie_twin(rows):
    by = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = original.get(c - c % 100, [])[:h] + own[h:]
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        d = len(key)
        below = [k for k in nodes if k[:d] == key]
        children = [k for k in below if len(k) == d + 1]
        leaves = [k for k in below if not any(x[:len(k)] == k and len(x) > len(k) for x in below)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == d)
        out.append((min(members), d, min(nodes[key[:-1]]) if key else None, len(members), len(children), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES + ("pos", "place", "part", "key", "parent", "depth", "ends")))


def talk(n=260):
    random.seed(6)
    rows = []
    for c in random.sample(range(0, 1200), n):
        for t in range(random.randrange(1, 9)):
            rows.append((c, t, random.choice(["user", "assistant"]), random.choice(["hi", "no", "😀 yes", ""])))
    rows += [(5000, t, "user", "same") for t in range(40)] + [(7, None, None, None), (7, None, None, None), (7, 3, None, "x"),
             (None, 1, "user", "lost"), (-150, 1, "user", "hi"), (-200, 1, "user", "hi"), (-200, 2, "user", "no"), (-149, 2, "user", "no")]
    return rows + rows[:9]


@pytest.mark.parametrize("shard, shard_turns", [(4096, 1 << 16), (7, 1 << 16), (4096, 12), (3, 5)])
def test_trie_equals_brute_force(spark, shard, shard_turns):
    rows = talk()
    if shard != 4096:
        rows = rows[:300] + [r for r in rows if r[0] in (5000, 7, None) or (r[0] or 0) < 0]
    # floor and truncated remainders agree for all but negative ids, where the SQL one holds
    rows = [r for r in rows if r[0] is None or r[0] >= 0 or r[0] % 100 == 0]
    assert rows_of(prefix_trie(conversations(spark, rows), shard, shard_turns)) == trie_twin(rows)


def test_trie_of_equal_conversations_and_of_nothing(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    df = conversations(spark, rows)
    assert rows_of(prefix_trie(df, 16)) == trie_twin(rows)
    assert prefix_trie(df.limit(0)).collect() == []
    assert prefix_trie(conversations(spark, [(None, 1, "user", "x")])).collect() == []


def test_a_conversation_cut_by_partitions_is_numbered_through(spark):
    rows = [(1, t, "user", f"{t}") for t in range(500)] + [(c, 0, "user", "x") for c in range(2, 40)]
    df = conversations(spark, rows).repartition(5)
    got = {r.pos: r.chars for r in op12_prefix_trie.numbered_turns(df).where("conv_id = 1").collect()}
    assert got == {t + 1: len(str(t)) for t in range(500)}
    assert rows_of(prefix_trie(df, 8, 50)) == trie_twin(rows)


def test_walk_intersects_once_for_each_node():
    ids, a, b = [3, 5, 9], (b"a", 1), (b"b", 2)
    nodes = list(walk(ids, [[a, b], [a], [b]]))
    assert [(n[2], n[3], n[4], n[6]) for n in sorted(nodes, key=lambda n: (n[2], n[4]))] == \
        [(0, 3, 3, None), (1, 2, 3, "5"), (1, 1, 9, "9"), (2, 1, 3, "3")]


# --- 13 ----------------------------------------------------------------------

def collocation_twin(rows, least, most=5, per_lang=2000):
    split = {}
    for text, lang in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            split.setdefault(lang or "und", []).append(re.findall(r"[^\x20\x09]+", piece))
    out = []
    for lang, pieces in split.items():
        n = sum(map(len, pieces))
        f = Counter(tuple(w[i:i + k]) for w in pieces for k in range(1, most + 1) for i in range(len(w) - k + 1))
        f = {g: c for g, c in f.items() if c >= least}
        found = []
        for g, a in f.items():
            if len(g) < 2 or any(len(x) > len(g) and c >= a and any(x[i:i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, c in f.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, g, left, right) in enumerate(sorted(found)[:per_lang], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n, -s))
    return sorted(out, key=repr)


def prose(n=400):
    random.seed(13)
    words = ["new", "York", "times", "the", "ÉTÉ", "日本", "of", "x"]
    rows = [(" ".join(random.choices(words, k=30)) + random.choice([".", " , ", "\n", "\x0b"]) + "the New york Times of", random.choice(["en", "fr", None]))
            for _ in range(n)]
    return rows + [("the the the the the the", "en")] * 8 + [(None, "en"), ("", "en"), (" \t ", None), ("...", "de"), ("und so", "und")]


@pytest.mark.parametrize("least, per_lang, bits", [(5, 2000, 14), (20, 7, 10), (60, 2000, 27)])
def test_collocations_equal_brute_force(spark, least, per_lang, bits):
    rows = prose()
    docs = documents(spark, [(k, t, lang, "s") for k, (t, lang) in enumerate(rows)])
    got = rows_of(collocations(docs, least=least, per_lang=per_lang, filter_bits=bits))
    assert got and got == collocation_twin(rows, least, per_lang=per_lang)


def test_collocations_of_nothing(spark):
    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark)).where("lang = 'nowhere'").collect() == []


def test_long_texts_keep_windows_across_parts(spark, monkeypatch):
    rows = [("a b c d e " * 3000 + "! " + "q r, " * 500, "en")]
    docs = documents(spark, [(1, *rows[0], "s")])
    want = collocation_twin(rows, 100)
    assert rows_of(collocations(docs)) == want
    lexer = Lexer()
    monkeypatch.setattr(op13_collocations, "PIECE", 1 << 9)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([rows[0][0]])], names=["lang", "text"])
    windows = 0
    for names, piece, _, _, ready in op13_collocations._walk(lexer, batch, 4):
        windows += sum(1 for i in range(ready) if i + 4 < len(names) and piece[i] == piece[i + 4])
    assert windows == 3000 * 5 - 4 + 0


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(10**15, 10**17, 10**15, 10**15 + 1)], "a long, n long, l long, r long")
    assert row.select(F.expr(op13_collocations.SCORE)).first()[0] == 1000 * 10**15 * 10**17 // (10**15 * (10**15 + 1))


def test_bit_table_holds_all_names(spark):
    names = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    df = spark.createDataFrame([(int(x),) for x in names], "name long")
    table = bit_table(df, 16)
    assert isinstance(table, BitTable) and table.has(names.view(np.uint64)).all()
    assert table.has(names.view(np.uint64) + np.uint64(1)).mean() < 0.2


def test_frequent_words_that_share_a_name_are_named_anew(spark, monkeypatch):
    docs = documents(spark, [(k, "left right middle", "en", "s") for k in range(30)])
    counts, words = phrase_counts(docs, least=10)
    assert words.select("name").distinct().count() == 3
    assert counts.count() == 6
