"""The training-data operators against brute force, on small tables with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import chat_format as C
from tessera.llm import textkernel as K
from tessera.llm.bpe_automaton import TextEncoder, encode_texts
from tessera.llm.exact_dedup import drop_copies, exact_groups
from tessera.llm.jaccard_join import keep_one, near_duplicates, similar_classes, similar_pairs
from tessera.llm.line_dedup import remove_repeated_lines
from tessera.llm.packing import pack
from tessera.llm.quality_gam import FEATURES, features, fit, with_score
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_files import read_back, write_tokens
from tessera.llm.topk_bsi import Block, top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, ranges int, size string"


@pytest.fixture(autouse=True, scope="module")
def small_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def texts(seed=1, n=24):
    r = random.Random(seed)
    words = ["a", "b", "C", "de", "ü", "longerwordthanten", "."]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n - 6:
        t = r.choice(base).split(" ")
        if t and r.random() < 0.6:
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t[r.randrange(3) :]) if r.random() < 0.5 else " ".join(t))
    return [*out, "", "   ", "x", "one two\tthree\nfour", "same line\n" * 40, "  odd\x1cspaces\x85 here"]


def table(spark, values, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", 1, "clash", 2, "clash") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def awkward(spark):
    """Nulls in every column, a repeated row, a repeated id with another text, and a very long text."""
    long = " ".join(str(i % 997) for i in range(30_000))
    rows = [(0, None, None, None, None, None, None, None), (None, "some text here", "en", None, 1, None, None, None), (2, "twice", "en", "s", 5, None, None, None), (2, "twice", "en", "s", 5, None, None, None), (2, "other", "en", "s", 5, None, None, None), (3, long, "en", "s", 5, None, None, None), (4, long, "en", "t", 5, None, None, None), (5, "", "en", "t", 0, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", text.encode())


def brute_windows(values, width, split):
    seen, out = set(), {}
    for d, t in enumerate(values):
        u = split(t)
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            w = tuple(u[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        out[d] = (len(u), sum(gone), [x for x, g in zip(u, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    values = texts(seed, 30)
    want = brute_windows(values, 20, words)
    for r in remove_repeats(table(spark, values)).collect():
        n, gone, kept = want[r["doc_id"]]
        assert (r["__n_units"], r["__n_removed"], r["__sha"]) == (n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()), r["doc_id"]
        assert r["k1"] == "clash"


def test_line_dedup(spark):
    values = ["a\nb\nc\nd", "x\na\nb\nc\ny", "b\nc\nd\n\nq", "a\nb", "", "z\nz\nz\nz\nz"]
    want = brute_windows(values, 3, lambda t: [x for x in t.split("\n") if x])
    got = {r["doc_id"]: r for r in remove_repeated_lines(table(spark, values)).collect()}
    for d, (n, gone, kept) in want.items():
        assert (got[d]["n_lines"], got[d]["n_removed"]) == (n, gone)
        assert got[d]["kept_text"] == ("\n".join(kept) if gone else values[d])


def test_repeated_lines_of_runs_shorter_than_three(spark, tmp_path):
    from tessera.llm.queries import SQL, queries

    values = ["one\ntwo\nthree\nfour", "x\none\ntwo\ny", "three", "z\nz", "", "new\n\nfour\nnew", "x\ny\nthree\nend"]
    spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_windows(values, 1, lambda t: [x for x in t.split("\n") if x])
    want = sorted((d, n, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest()) for d, (n, gone, kept) in want.items())
    assert [w[2] for w in want] == [0, 2, 1, 1, 0, 2, 3]
    assert sorted(map(tuple, queries()["op1_repeated_lines"](spark, str(tmp_path)).collect())) == want
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(SQL["op1_repeated_lines"]).fetchall()) == want


def test_winnowing_selects_the_same_line_of_equal_windows():
    from tessera.llm.line_dedup import selected

    r = random.Random(4)
    lines = [[r.choice("abcdef") for _ in range(r.randrange(9))] for _ in range(40)]
    units = K.units_of(["\n".join(x).encode() for x in lines], "line")
    for width in (1, 2, 3, 5):
        at, pick = selected(units, width)
        assert len(at) == sum(max(len(x) - width + 1, 0) for x in lines)
        flat = [y for x in lines for y in x]
        place = collections.defaultdict(set)
        for a, p in zip(at.tolist(), pick.tolist(), strict=True):
            place[tuple(flat[a : a + width])].add(p - a)
        assert all(len(v) == 1 for v in place.values())


@pytest.mark.parametrize("width", [2, 3, 4])
def test_line_dedup_of_many_runs(spark, width):
    r = random.Random(width)
    values = ["\n".join(r.choice(["a", "b", "c", "d", "", "a long line of words"]) for _ in range(r.randrange(14))) for _ in range(40)]
    want = brute_windows(values, width, lambda t: [x for x in t.split("\n") if x])
    for x in remove_repeated_lines(table(spark, values), width=width).collect():
        n, gone, kept = want[x["doc_id"]]
        assert (x["n_lines"], x["n_removed"], x["kept_sha256"]) == (n, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_buckets_hold_no_large_key(spark, monkeypatch):
    from tessera.llm import repeats

    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1500)
    values = [" ".join(f"w{(i * k) % 7 if i < 25 else (i, k)}" for i in range(40)).replace("'", "") for k in (1, 1, 1, 2, 2, 3)] * 8
    want = brute_windows(values, 20, words)
    for x in remove_repeats(table(spark, values)).collect():
        n, gone, kept = want[x["doc_id"]]
        assert (x["__n_removed"], x["__sha"]) == (gone, hashlib.sha256(b" ".join(kept)).hexdigest())
    packed = [b" ".join(b"x%d" % (i // 2) for _ in range(20)) for i in range(200)]
    rows = pa.RecordBatch.from_pydict({"key": pa.array([5] * 200, pa.int64()), "k1": pa.array(range(200), pa.int64()), "k2": pa.array([0] * 200, pa.int64()), "start": pa.array([0] * 200, pa.int64()), "n": pa.array([1] * 200, pa.int64()), "packed": pa.array(packed, pa.binary())})
    out = [t for t in repeats._bucket("word", 20)(rows.slice(i, 10) for i in range(0, 200, 10))]
    digests = [d for t in out for d in t["digest"].to_pylist()]
    assert len(digests) == 200 and len(set(digests)) == 100 and None not in digests


def test_windows_with_colliding_hashes(monkeypatch):
    from tessera.llm.repeats import _Windows

    zero = np.zeros(3, np.int64)
    w = _Windows([b"a b", b"c d", b"a b"], np.arange(3), zero, zero, "word", 2)
    first, later = w.resolve(np.zeros(3, np.uint64))
    assert first.tolist() == [True, True, False] and later.tolist() == [False, False, True]


def test_kernels():
    u = K.units_of([b" a  bb\n", b"", b"ccccccccccc a"], "word")
    assert u.raw == b"a bb ccccccccccc a " and u.first.tolist() == [0, 2, 2, 4] and u.hash[0] == u.hash[3]
    x = np.array([5, 3, 9, 1, 7], np.uint64)
    assert K.window_min(x, 3).tolist() == [3, 1, 1]
    assert len(K.window_hash(x, 6)) == 0


def brute_components(values):
    sets = []
    for t in values:
        w = words(t.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(values)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


#: Two words that the hash of words cannot tell apart.
COLLIDING = (["alphabetagamma01"], ['8sw37fbt*?0"5,+<'])


def test_colliding_shingles_are_told_apart():
    from tessera.llm import jaccard_join as J

    a, b = (w[0].encode() for w in COLLIDING)
    five = lambda w: b" ".join([w] * 5)
    s = J._Shingled([five(a), five(b), five(a) + b" " + five(b), five(a).upper(), b"", five(a) + b" " + five(a)], 5)
    assert s.hash[0] == s.hash[1]
    sets, at = s.sets()
    assert [len(x) for x in sets] == [1, 1, 6, 1, 0, 1]
    ids = K.unit_ids(s.units)
    common = lambda i, j: J._common(sets[i], sets[j], at[i], at[j], ids, 5)
    assert [common(0, 1), common(0, 2), common(1, 2), common(0, 3), common(0, 5), common(2, 2)] == [0, 1, 1, 1, 1, 6]
    assert np.array_equal(J._signature(sets[0]), J._signature(sets[1]))


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join(spark, seed):
    values = [*texts(seed, 45), *(" ".join(w * 5) for w in COLLIDING)]
    values += [" ".join([*COLLIDING[0] * 5, "x", "y", *COLLIDING[1] * 5]), " ".join([*COLLIDING[1] * 5, "x", "y", *COLLIDING[0] * 5])]
    docs = table(spark, values)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == brute_components(values)
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == sorted({c for _, c in got.values()})


@pytest.mark.parametrize("seed", [3, 4])
def test_similar_pairs(spark, seed):
    base = [f"w{seed}x{i}" for i in range(120)]
    values = [*texts(seed, 30), *[" ".join([*base[:110], *[f"end{k}y{i}" for i in range(k)]]) for k in range(12)], " ".join(base[3:110])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 0))} or ({tuple(w)} if w else set()) for w in (words(v.lower()) for v in values)]
    sets = {i: s for i, s in enumerate(sets) if s and s not in sets[:i]}
    want = sorted((i, j) for i, s in sets.items() for j, t in sets.items() if i < j and 100 * len(s & t) >= 80 * len(s | t))
    classes, links = similar_pairs(table(spark, values))
    rep = {r["cid"]: r["rep"] for r in classes.collect()}
    assert sorted(tuple(sorted((rep[a], rep[b]))) for a, b in links.collect()) == want and len(want) > 60
    assert sorted(rep.values()) == sorted(sets) and len(similar_classes(table(spark, values))[1].collect()) < len(want)


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    make = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: make(k) + " tail"
    least = -(2**63)  # an id like others
    rows = [(least, make(6)), (3, make(0)), (7, near(0)), (7, make(1)), (9, make(2)), (9, make(2)), (None, make(3)), (None, near(3)), (None, make(4)), (None, None), (None, " "), (None, " "), (11, make(5)), (11, near(5))]
    got = [tuple(r)[:2] for r in keep_one(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __id string").repartition(3)).collect()]
    sure = [(least, make(6)), (3, make(0)), (7, make(1)), (9, make(2)), (None, make(4)), (None, None), (None, " "), (None, " ")]
    assert collections.Counter(r for r in got if r in sure) == collections.Counter(sure)
    rest = [r for r in got if r not in sure]
    assert len(rest) == 2 and sum(r in rows[6:8] for r in rest) == 1 and sum(r in rows[12:] for r in rest) == 1


def test_bpe_automaton(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = TextEncoder(path), Tokenizer.from_file(path)
    r = random.Random(5)
    values = [*texts(), "it's <|endoftext|>x<|startoftext|> İΣ ΣΑΣ 12½ ''''s é", "aaaaaaa mississippi " * 3, "日本語 ​ 😀👍🏽"]
    values += ["".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x300, 0x3000), r.randrange(0x1F000, 0x1FA00)])) for _ in range(12)) for _ in range(200)]
    for t in values:
        want = lib.encode(t, add_special_tokens=False).ids
        ids, decoded = own(t.encode())
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert decoded.decode() == lib.decode(want, skip_special_tokens=False) == own.decode(want)
    got = {r["doc_id"]: list(r["ids"]) for r in encode_texts(awkward(spark), "word_bpe_49k.json").collect()}
    assert got[0] == [] and got[None] == lib.encode("some text here", add_special_tokens=False).ids


def brute_bpe(word, ranks):
    """Merges in order of rank, leftmost first."""
    parts = list(word)
    while True:
        best = min((ranks.get(p, len(ranks)), i) for i, p in enumerate([*zip(parts, parts[1:]), ("", "")]))
        if best[0] == len(ranks):
            return parts
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]


@pytest.mark.parametrize("seed", range(4))
def test_words_of_random_vocabularies(seed):
    from tessera.llm.bpe_automaton import WordEncoder

    r = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < 25:
        pair = (r.choice(tokens), r.choice(tokens))
        if pair[0] + pair[1] not in tokens and len(pair[0] + pair[1]) < 9:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    vocabulary = {t: i for i, t in enumerate(tokens)}
    encode, ranks = WordEncoder(vocabulary, merges, ""), {m: i for i, m in enumerate(merges)}
    assert encode("") == []
    for _ in range(400):
        word = "".join(r.choice("abc") for _ in range(r.randrange(1, 30)))
        assert [tokens[i] for i in encode(word)] == brute_bpe(word, ranks), word
    assert len(encode("abc" * 20_000)) > 0


def test_exact_dedup(spark):
    values = ["a b", "ab", "a  b ", "", " ", "x", "X"]
    got = {r["doc_id"]: tuple(r)[1:4] for r in exact_groups(table(spark, values)).collect()}
    assert got == {0: (2, 3, False), 1: (2, 3, False), 2: (2, 3, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 1, True)}
    assert sorted(r["doc_id"] for r in drop_copies(table(spark, values)).collect()) == [2, 4, 5, 6]


def test_exact_dedup_in_several_rounds(spark):
    from pyspark.sql import functions as F
    from tessera.llm import exact_dedup as E

    assert [E.leaves_for(n, 10, 4) for n in (0, 160, 161, 641)] == [16, 16, 64, 256]
    values = [f"t{i % 37}" + " " * (i % 3) for i in range(400)]
    rows = E.digests(table(spark, values), "doc_id", "text")
    for leaves in (4, 16, 64):
        got = E.tree_merge(rows, leaves, 4).select(F.bitwise_not("best.flipped").alias("id"), "size").collect()
        want = {min((-len(t), i) for i, t in enumerate(values) if t.strip() == f"t{k}")[1] for k in range(37)}
        assert {r["id"] for r in got} == want and sum(r["size"] for r in got) == 400 and len(got) == 37


def test_exact_dedup_keeps_columns_of_any_name(spark):
    least = -(2**63)
    rows = [(least, "a", 1, 2, 3), (None, "a", 4, 5, 6), (None, "b", 7, 8, 9), (None, "b", 7, 8, 9)]
    got = drop_copies(spark.createDataFrame(rows, "doc_id long, text string, row long, __turn long, __digest long")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [("a", 1, 2, 3), ("b", 7, 8, 9)] and {r["doc_id"] for r in got} == {least, None}
    told = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_groups(spark.createDataFrame(rows[:2], "doc_id long, text string, a long, b long, c long")).collect()}
    assert told == {(least, least, True), (None, least, False)}


def test_exact_dedup_writes_no_texts(spark):
    import os
    from tessera.llm.storage import shared_dir

    r = random.Random(4)
    texts = ["".join(r.choices("abcdefghij klmnop", k=20_000)) for _ in range(40)]
    rows = [(i, texts[i % 40] + " " * (i % 3), i) for i in range(60)] + [(3, texts[3], 100), (None, texts[5], 101), (None, "x", 102), (None, "x", 103), (7, " x", 104), (7, "x ", 105), (61, None, 106)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long").repartition(3)
    top = shared_dir(spark).removeprefix("file://")
    used = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = used()
    out = drop_copies(docs)
    assert used() - before < 200_000  # of 1.2 MB of texts
    best: dict[str, tuple] = {}
    for i, text, _ in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        best[key] = min(best.get(key, (1, True, 0)), (-len(text or ""), i is None, i or 0))
    got = out.collect()
    assert sorted((-len(x["text"] or ""), x["doc_id"] is None, x["doc_id"] or 0) for x in got) == sorted(best.values())
    assert {(x["doc_id"], x["text"], x["k"]) for x in got} <= set(rows) and out.columns == docs.columns


def test_exact_dedup_of_awkward_rows(spark):
    rows = exact_groups(awkward(spark)).collect()
    assert len(rows) == 8 and sum(r["kept"] for r in rows) == 5
    assert sorted((r["doc_id"] is None, r["doc_id"], r["kept"]) for r in rows if r["group_size"] == 2 and r["doc_id"] in (2, 3)) == [(False, 2, False), (False, 2, True), (False, 3, True)]
    assert drop_copies(awkward(spark)).count() == 5


LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*LIB.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


SPECIAL = ["two  spaces \n here", "tab\t x", "<|endoftext|> end<|endoftext|>", "日本 語", "x" * 3000, " lead", "trail ", "é́ \xa0 y"]


def test_token_files(spark):
    values = [*texts(), *SPECIAL]
    got = {r["doc_id"]: tuple(r)[1:] for r in read_back(write_tokens(table(spark, values), row_tokens=32, batch_rows=2, file_docs=7)).collect()}
    at = 0
    for d, t in enumerate(values):
        x = ids_of(t)
        assert got[d] == (at, len(x), zlib.crc32(x.tobytes())), t
        at += len(x)


def test_packing(spark):
    values = [*texts(), *SPECIAL]
    rows = pack(table(spark, values), length=64, window_tokens=300, with_ids=True).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(dict)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
    for d, t in enumerate(values):
        assert b"".join(x for _, x in sorted(pieces[d].items())) == ids_of(t).tobytes()
    sizes = []
    for k in sorted(sequences):
        at = 0
        for offset, n in sorted(sequences[k]):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == 64 for s in sizes[:-1]) and 0 < sizes[-1] <= 64
    source = {d: f"s{d % 3}" for d in range(len(values))}
    total = collections.Counter()
    for d, t in enumerate(values):
        total[source[d]] += len(ids_of(t))
    share = collections.defaultdict(collections.Counter)
    for r in rows:
        share[r["window"]][source[r["doc_id"]]] += r["length"]
    longest = max(len(ids_of(t)) for t in values)
    served = collections.Counter()
    for w in sorted(share):  # deficits carry on: what a source got by then is within one document of its share
        served += share[w]
        for s in total:
            credit = (w + 1) * 300 * total[s] / sum(total.values())
            assert served[s] <= credit + 1 and (served[s] >= credit - longest or served[s] == total[s])


def served_by(spark, sizes, weights, window):
    """Tokens of each source by window, for queues of documents of one token."""
    rows = [(i, "", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = collections.defaultdict(collections.Counter)
    of = {i: s for i, _, s in rows}
    for r in pack(docs, length=8, window_tokens=window, weights=weights, segment_docs=5).collect():
        out[r["window"]][of[r["doc_id"]]] += r["length"]
    return [dict(out[w]) for w in range(max(out) + 1)]


def test_packing_by_weights(spark):
    got = served_by(spark, {"a": 90, "b": 30}, {"a": 0.5, "b": 0.5, "unknown": 3.0}, 20)
    assert got == [{"a": 10, "b": 10}] * 3 + [{"a": 20}] * 3  # b is dry after three windows, and a takes its credit
    got = served_by(spark, {"a": 18, "b": 18, "z": 4}, {"a": 9, "b": 1, "z": 0}, 10)
    assert got == [{"a": 9, "b": 1}, {"a": 9, "b": 1}, {"b": 10}, {"b": 6, "z": 4}]
    got = served_by(spark, {"a": 30, "b": 10, "c": 20}, {"a": 0.25}, 20)  # b and c have their shares, 1/6 and 1/3
    assert sum(sum(w.values()) for w in got) == 60 and all(abs(sum(w.values()) - 20) < 3 for w in got) and got[0]["a"] in (6, 7)
    assert served_by(spark, {"a": 6, "b": 6}, {"a": 0, "b": 0}, 4) == [{"a": 2, "b": 2}] * 3
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="weight"):
            pack(spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string"), weights={"a": bad})


def test_packing_of_awkward_rows(spark):
    rows = pack(awkward(spark)).collect()
    n = collections.Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert sum(n.values()) == 8 and n[(2, len(ids_of("twice")))] == 2
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = 0
    for s, o, k in places:
        assert s * 1024 + o == at
        at += k


def test_top_k(spark):
    r = np.random.default_rng(7)
    x = r.normal(0, 0.2, (150, 9))
    x[20:60] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200, None), (201, [None] * 9), (202, [float("nan")] * 9), (203, [float("inf")] * 9), (None, x[0].tolist()), (204, [1e6] + [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for q in top_k(df, df.filter("vec_id % 10 = 0"), 5, block_rows=40, query_rows=6).collect():
        got[q["query_id"]].append((q["rank"], q["vec_id"], q["score"]))
    whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and (i < 200 or i == 204)}
    for q in [i for i in whole if i % 10 == 0]:
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert top_k(few, few, 5).count() == 2


def test_top_k_of_large_and_empty_vectors(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [0.5, 0.25]), (4, [1e17, -1e17]), (5, [1.0, 1.0]), (6, [3e4, 4e4]), (10, []), (11, []), (20, [1.0]), (20, [-1.0]), (21, [2.0]), (22, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for q in top_k(df, df, 3, block_rows=4, query_rows=3).collect():
        got[q["query_id"]].append((q["rank"], q["vec_id"], q["score"]))
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    for q in range(7):
        best = sorted((-cut(sum(a * b for a, b in zip(whole[q][1], v, strict=True))), i) for i, v in whole if i != q and len(v) == 2)[:3]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert got[10] == [(1, 11, 0)] and got[11] == [(1, 10, 0)]
    assert sorted(got[20]) == [(1, 22, 256 * 768), (2, 21, 256 * 512), (3, 21, -256 * 512)]
    assert len(Block(np.arange(3), np.zeros((3, 0), np.int64)).top(0, np.zeros(0, np.int64), 5)[0]) == 2


def test_blocks_of_any_range():
    r = np.random.default_rng(3)
    for low, high in ((0, 1), (5, 6), (-100_000, 100_000), (-3, 90)):
        x = r.integers(low, high, (130, 6))
        b = Block(np.arange(130), x)
        for q in (x[0], np.zeros(6, np.int64), -x[1]):
            ids, score = b.top(-1, q, 7)
            want = sorted((-(x @ q)[i], i) for i in range(130))[:7]
            assert [(-s, i) for s, i in zip(score, ids, strict=True)] == want


def test_quality(spark):
    good = ["The reader went home and read the paper again, with some care. It was fine. " * 3, "Words of many kinds, one after another; nothing odd about any of them. "]
    bad = ["BUY!! NOW!! CHEAP!! BEST!! " * 6, "go go go go go go go go go go go go go go"]
    r = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        kind = i % 2
        text = r.choice(good if kind else bad)
        rows.append((i, text + " " + " ".join(r.choice(["one", "two", "three", "four", "five"]) for _ in range(r.randrange(5))), "en", "s", 1, "c", 1, "c"))
        labels.append((i, kind, 0))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None), (999, "", "en", "s", 0, "c", 1, "c")], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["__score"] for x in with_score(docs, known).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == bool(i % 2) for i in held) and len(held) > 20
    assert 0 <= got[999] <= 1 and 0 <= got[None] <= 1
    assert with_score(docs, known.limit(0)).select("__score").distinct().count() == 1
    assert features([b"", b"x"]).shape == (2, len(FEATURES))


def test_features_hold_little_beside_their_texts():
    import tracemalloc

    r = np.random.default_rng(5)
    words = ["a", "Word", "seven", "1234", "!!", "longer-than-15-letters", "|", "x\ny", "\n", " "]
    texts = [" ".join(words[k] for k in r.integers(0, len(words), r.integers(0, 900))).encode() for _ in range(2000)]
    texts[7], texts[8], texts[-1] = b"", b"long text\n" * 200_000, b""
    assert sum(map(len, texts)) > 6 << 20
    tracemalloc.start()
    got = features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # 171 MB for all texts at once
    some = [0, 6, 7, 8, 9, 500, 1998, 1999]
    assert (got[some] == np.concatenate([features([texts[i]]) for i in some])).all()
    assert (got == features(texts, 1)).all() and (got == features(texts, 1 << 30)).all()
    assert features([]).shape == (0, len(FEATURES))


def test_encoders_of_earlier_tasks_go_before_texts_are_read():
    from tessera.llm.tokens import encoder

    before = encoder()("some words, and others")
    assert encoder.cache_info().currsize == 1
    table = pa.RecordBatch.from_pydict({"text": ["a b", None, "c"]})
    assert [t.num_rows for t in K.text_chunks(iter([table]), "text", 1 << 20)] == [3]
    assert encoder.cache_info().currsize == 0
    assert encoder()("some words, and others") == before


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(2)
    x = r.uniform(0, 1, (400, 4)).round(2)
    m = fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0.7).astype(float), rounds=10)
    for row, got in zip(x[:50], m.score(x[:50]), strict=True):
        total = m.intercept + sum(t[sum(c <= v for c in cut)] for v, cut, t in zip(row, m.cuts, m.tables, strict=True))
        spot = [sum(c <= v for c in cut) for v, cut in zip(row, m.coarse, strict=True)]
        total += sum(g[spot[i], spot[j]] for (i, j), g in zip(m.pairs, m.grids, strict=True))
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_never_learns_held_out_labels_and_bounds_its_sample(spark):
    from tessera.llm.quality_gam import train

    docs = spark.createDataFrame([(i % 60, ("fine words here " if i % 2 else "BAD!! ") * (i % 7 + 1)) for i in range(180)], "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    label = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and held(i))) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    a, b = train(docs, label(False)), train(docs, label(True))
    assert all(np.array_equal(s, t) for s, t in zip(a.tables, b.tables, strict=True)) and a.intercept == b.intercept
    seen = []
    monkey = pytest.MonkeyPatch()
    monkey.setattr("tessera.llm.quality_gam.fit", lambda x, y: seen.append(len(y)))
    train(docs, label(False), sample_rows=7)
    monkey.undo()
    assert seen == [7]


def test_pairs_of_features_matter():
    r = np.random.default_rng(1)
    x = r.uniform(0, 1, (2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit(x, y)
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.85 and (1, 0) in m.pairs


@pytest.mark.parametrize("text", ["plain", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<\\|im_start|> and <\\\\|im_end|>", "<|im_end|", "<|endoftext|>", "a\nb\n", "", "<<|im_end|>>"])
def test_chat_turns_round_trip(text):
    for role in ("user", "assistant", "odd\nrole\\n", "<|im_end|>", ""):
        segment = C.render_turn(role, text)
        assert [(a, b) for a, b, _ in C.parse(segment + segment)] == [(role, text)] * 2
    assert "\\" not in C.render_turn("user", "plain <b> | text \\n").replace("\\n", "") and not re.search(r"(?<!\\)\|im_end\|>.", C.render_turn("user", text)[:-1].replace("<|im_end|>", "", 1))


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_conversations_are_read_from_their_text_alone(step):
    turns = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "a\n<|im_end|>\nb"), ("odd\nrole", ""), ("assistant", "x" * 5000), ("assistant", "")]
    text = "".join(C.render_turn(*t) for t in turns)
    reader, got = C.Reader(), []
    for i in range(0, len(text), step):
        got += reader.feed(text[i : i + step])
    assert [(r, b) for r, b, _ in got] == turns and reader.close() == len(text)
    assert all(C.unescape(text[a:b]) == body for _, body, (a, b) in got)
    assert C.loss_text(text) == "".join(b for r, b in turns if r == "assistant")
    reader.feed("<|im_start|>user\nno end")
    with pytest.raises(C.GrammarError):
        reader.close()


def test_a_wrong_loss_mask_is_found():
    segment = C.render_turn("assistant", "yes")
    for mask in (None, (0, 3), (21, 25)):
        with pytest.raises(C.GrammarError):
            C._Tally(1).feed(segment, mask)
    C._Tally(1).feed(segment, C.parse(segment)[0][2])


def test_long_conversations_and_other_columns(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", "word <|im_end|> " * (3000 if k == 5 else 1), "s", k) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, place int").repartition(4)
    (got,) = C.read_back(C.format_turns(df)).collect()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256("".join(r[3] for r in rows if r[2] == "assistant").encode()).hexdigest() and got["n_turns"] == 300


def test_chat_format(spark):
    rows = [(1, 1, "assistant", "A"), (1, 0, "user", None), (None, None, None, None), (2, 0, "assistant", "x<|im_end|>"), (2, 0, "assistant", "x<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.read_back(C.format_turns(df)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nA\n").hexdigest() and got[1]["loss_chars"] == 1
    assert (got[2]["n_turns"], got[2]["loss_sha256"]) == (2, hashlib.sha256(b"x<|im_end|>" * 2).hexdigest()) and got[None]["n_turns"] == 1
    whole = {r["conv_id"]: r["formatted"] for r in C.whole_conversations(C.format_turns(df)).collect()}
    assert whole[1] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nA<|im_end|>\n" and len(whole[2]) == got[2]["formatted_chars"]


def test_awkward_rows_of_windows_and_sets(spark):
    docs = awkward(spark)
    got = remove_repeats(docs).collect()
    assert len(got) == 8 and {r["doc_id"]: r["__n_units"] - r["__n_removed"] for r in got if r["doc_id"] in (3, 4)}[4] == 0
    near = near_duplicates(docs).collect()
    assert len(near) == 8 and {r["component_id"] for r in near if r["doc_id"] in (3, 4)} == {3}
    assert remove_repeated_lines(docs).count() == 8
    assert read_back(write_tokens(docs)).count() == 8


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (remove_repeats(docs), remove_repeated_lines(docs), near_duplicates(docs), exact_groups(docs), pack(docs), read_back(write_tokens(docs)), with_score(docs, labels), top_k(vectors, vectors, 5), C.read_back(C.format_turns(turns)), encode_texts(docs, "word_bpe_49k.json")):
        assert df.count() == 0
