"""Text operators against brute force, on edge cases and on the small tables."""

import inspect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, components, langid, line_dedup, packing, quality_fm, queries, simhash, token_codes, toxicity, word_tokens
from tidemark.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, ids string, t_id long, fp string"
EDGE_TEXTS = [None, "", " ", "a", "A b", "a b c d", "x " * 3000, "same text here now", "same text here now", "ÄÖ é́ 漢字 \x1c\x85 <|endoftext|> don't", "tab\tand\nlines\n\nmore"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k if k != 4 else None, t, "en" if k % 2 else None, "s", 1, 7, "clash", 5, "clash") for k, t in enumerate(EDGE_TEXTS)]
    rows.append((7, "same text here now", "en", "s", 1, 7, "clash", 5, "clash"))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vocabulary():
    return word_tokens.read_vocabulary(public_tokenizers.path(queries.WORD_VOCABULARY))


@pytest.fixture(scope="module")
def encode(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary)  # as the library is, without settings
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


# ---- 1: token codes ----


@pytest.mark.parametrize("bits", [1, 5, 8])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_levels_round_trip_and_random_access(bits, n):
    rng = np.random.default_rng(n + bits)
    ids = rng.integers(0, 1 << rng.integers(1, 32), n).astype(np.uint32)
    levels = token_codes.Levels(token_codes.pack_levels(ids, bits))
    assert (levels.all() == ids).all() and len(levels) == n
    assert all(levels[k] == ids[k] for k in range(0, n, 41))
    with pytest.raises(IndexError):
        levels[n]


def test_token_file(spark, edge, vocabulary, encode):
    path = scratch_path(spark, "t")
    token_codes.write_token_codes(edge, path, vocabulary, 1, segment_tokens=50, docs_per_part=2)
    got = token_codes.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 5, 6, 7, 7, 8, 9, 10]
    flat = []
    for r in got:
        assert r.start == len(flat)
        flat += r.ids
        assert r.ids == encode(EDGE_TEXTS[r.doc_id if r.doc_id is not None else 4])
    asked = spark.createDataFrame([(k,) for k in (0, 3, len(flat) - 1, len(flat), -1)], "position long")
    assert {r.position: r.token for r in token_codes.tokens_at(spark, path, asked).collect()} == {k: flat[k] for k in (0, 3, len(flat) - 1)}
    digest = {(r.start, r.n_tokens, r.ids_crc32) for r in token_codes.document_digests(spark, path).collect()}
    assert digest == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in got}


def test_empty_token_file(spark, edge, vocabulary):
    path = scratch_path(spark, "t")
    token_codes.write_token_codes(edge.limit(0), path, vocabulary, 1)
    assert token_codes.document_digests(spark, path).count() == 0


def test_words_equal_whole_texts(vocabulary, encode):
    rng, words = random.Random(5), word_tokens.WordTokens(vocabulary)
    parts = ["a", "B", " ", "  ", "\n", "'s", "don't", "é", "é", "Σ", "İ", "1", "12", "!!", ".", ",", "x.", "$$$", "_", "\x1c", "\x85", "漢", "straße", "<|endoftext|>", "<|", "<|EndOfText|>", "<|startoftext|>"]
    assert encode("hello <|endoftext|> world")[1] == 49407
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(words.ids(text), dtype=words.dtype).tolist() == encode(text)[:-1]


# ---- 2: byte-level BPE ----


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(queries.BYTE_RANKS))


def test_stitching_never_depends_on_chunks(ranks):
    bpe, rng = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "'re", "l", "é", "1", "!", "\t", "漢"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
        ends = [m.end() for m in bpe.pattern.finditer(text)]
        want = bpe.encoding.encode_ordinary(text)
        for chunk, overlap in ((4, 3), (9, 5), (16, 1)):
            assert bpe.stitched(text, chunk, overlap) == ends
            assert bpe.encode(text, chunk, overlap) == want
        assert bpe.decode(want) == text.encode()
    run = "x" * 500
    assert bpe.encode(run, 16, 4) == bpe.encoding.encode_ordinary(run)


def test_byte_bpe_round_trip(spark, edge, ranks):
    encoded = byte_bpe.encode(edge, ranks, public_tokenizers.PATTERN, 32, 8)
    texts = {r.doc_id: bytes(r.bytes).decode() for r in byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN).collect()}
    assert texts == {(k if k != 4 else None): t or "" for k, t in enumerate(EDGE_TEXTS)}
    assert byte_bpe.round_trip_digests(edge.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_round_trip_digests_equal_the_library(spark, edge, ranks):
    from hashlib import sha256

    rng = random.Random(6)
    long = "".join(rng.choice(["word", " ", "  ", "\n", "'ll", "é", "12345", "!?", "漢字", " Straße"]) for _ in range(900_000))
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(70, long), (71, "y" * 60_000), (70, "again " * 9000)], "doc_id long, text string"))
    library = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN).encoding
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    got = byte_bpe.round_trip_digests(docs, ranks, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    small = byte_bpe.round_trip_digests(docs.filter("length(text) < 60000 OR text IS NULL"), ranks, public_tokenizers.PATTERN, 40, 5)
    assert sorted(map(str, map(tuple, small.collect()))) == sorted(str(w) for w in want if w[0] != 70 and w[0] != 71 or w[1] < 60_000 and w[0] == 70)


# ---- 8: packing ----


def check_pieces(pieces, docs, window):
    by_doc, by_sequence = {}, {}
    for p in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert p[1] == by_doc.get(p[0], 0)
        by_doc[p[0]] = p[1] + p[2]
    assert by_doc == {k: len(d) for k, d in enumerate(docs) if len(d)}
    for p in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert p[2] > 0 and p[4] == by_sequence.get(p[3], 0)
        by_sequence[p[3]] = p[4] + p[2]
    for n in by_sequence.values():
        assert n == window or n & (n - 1) == 0 and n <= window


@pytest.mark.parametrize("seed", range(6))
def test_pack_shard(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 50, n).astype("<u4") for n in rng.integers(1, 300, 40)]
    check_pieces(list(packing.pack_shard(docs, np.ones(50), 100.0, 128, 8)), docs, 128)


def test_neighbours_equal_brute_force_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, n).astype("<u4") for n in rng.integers(5, 60, 30)]
    idf, mean = rng.random(60) + 0.1, 30.0
    index = packing.ShardIndex(docs, idf, mean, 8)
    index.unused[[0, 4]] = False
    query = set(index.query(0).tolist())
    assert len(query) <= 8
    score = {}
    for k, d in enumerate(docs):
        ids, n = np.unique(d, return_counts=True)
        s = sum(idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, c in zip(ids, n) if t in query)
        if s > 0 and index.unused[k]:
            score[k] = s
    got = list(index.neighbours(0, first=3))
    assert got == sorted(score, key=lambda k: (-round(score[k], 9), k)) or [round(score[k], 9) for k in got] == sorted((round(s, 9) for s in score.values()), reverse=True)


def test_used_documents_leave_the_postings():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 200, n).astype("<u4") for n in rng.integers(5, 90, 60)]
    idf = rng.random(200) + 0.1
    index = packing.ShardIndex(docs, idf, 40.0)
    for used in (0, 20, 45, 58):
        index.unused[:used] = False
        fresh = packing.ShardIndex(docs, idf, 40.0)
        fresh.unused[:used] = False
        scores = dict(zip(fresh.rows.tolist(), fresh.scores(59).tolist()))
        assert list(index.neighbours(59)) == sorted((k for k in range(used, 60) if scores[k] > 0), key=lambda k: (-round(scores[k], 9), k))
        assert len(index.rows) <= max(2, 2 * (60 - used))


def test_documents_with_common_heavy_terms_stand_together():
    rng = np.random.default_rng(4)
    topics = [rng.choice(np.arange(100, 5000), 60, replace=False) for _ in range(8)]
    docs = [np.concatenate([rng.choice(topics[k % 8], 50), rng.integers(0, 100, 50)]).astype("<u4") for k in range(800)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=5000)
    tree = packing.PlaceTree(np.log1p((800 - df + 0.5) / (df + 0.5)), 100.0)
    sketches = np.stack([tree.sketch(d) for d in docs])
    tree.fit(sketches[:400], 3)
    order = np.argsort(tree.places(sketches), kind="stable") % 8
    assert (order[1:] == order[:-1]).mean() > 0.8
    assert (tree.places(sketches[:3]) >> tree.FINE < 8).all()


def test_a_whole_document_is_the_query():
    idf = np.linspace(5, 1, 100)
    docs = [np.arange(40, dtype="<u4"), np.arange(39, 41, dtype="<u4"), np.arange(60, 70, dtype="<u4")]
    index = packing.ShardIndex(docs, idf, 20.0)
    index.unused[0] = False
    assert list(index.neighbours(0)) == [1]  # shares the lightest of 40 terms alone
    assert inspect.signature(packing.pack).parameters["query_terms"].default is None


def test_pack_documents(spark, edge, vocabulary, encode):
    rows = packing.pack(edge, vocabulary, 1, window=64).collect()
    assert sum(r.length for r in rows) == sum(len(encode(EDGE_TEXTS[k])) for k in range(len(EDGE_TEXTS))) + len(encode(EDGE_TEXTS[7]))
    one = {(r.start): np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in rows if r.doc_id == 6}
    assert sum((one[k] for k in sorted(one)), []) == encode(EDGE_TEXTS[6])
    assert packing.pack(edge.limit(0), vocabulary, 1).count() == 0


def test_document_frequencies(spark, edge, vocabulary, encode):
    from collections import Counter

    from tidemark.llm.common import texts

    tokens = word_tokens.tokenised(texts(edge), vocabulary, 1)
    want = Counter(t for text in [*EDGE_TEXTS, EDGE_TEXTS[7]] for t in set(encode(text)))
    assert packing.document_frequencies(tokens) == dict(want)


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_terms_of_many_documents_are_those_of_each(dtype):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40_000, n).astype(dtype) % (7 + n) for n in (0, 1, 300, 0, 5000, 2, 0)]
    owner, term, counts = packing.all_term_counts(docs)
    for number, ids in enumerate(docs):
        seen, n = packing.term_counts(ids)
        assert term[owner == number].tolist() == seen.tolist() and counts[owner == number].tolist() == n.tolist()
    assert [len(x) for x in packing.all_term_counts([docs[0]])] == [0, 0, 0] == [len(x) for x in packing.all_term_counts([])]


def test_frequencies_are_noted_while_documents_are_placed(spark, edge, vocabulary):
    from tidemark.llm.common import materialise, texts

    tree = packing.PlaceTree(np.ones(300), 20.0)
    for docs in (edge, edge.repartition(7), edge.limit(0)):
        placed = materialise(packing.placed_tokens(texts(docs), vocabulary, 1, tree), "placed")
        assert packing.noted_frequencies(placed) == packing.document_frequencies(placed)
        ids = [np.frombuffer(bytes(r.ids), dtype=f"<u{r.width}") for r in placed.select("ids", "width").collect()]
        if ids:
            assert np.array_equal(tree.sketches(ids, *packing.all_term_counts(ids)), np.stack([tree.sketch(x) for x in ids]))


def test_a_word_is_remembered_once_whatever_mark_follows(vocabulary, encode):
    words = word_tokens.WordTokens(vocabulary)
    for text in ("Anderblein, anderblein. anderblein", "straße,\nstraße. 3.14,15", "œil, a.b"):
        assert np.frombuffer(words.ids(text), dtype=words.dtype).tolist() + [1] == encode(text)
    assert "anderblein" in words and "straße" in words and not any(len(w) > 1 and ("," in w or "." in w) for w in words)
    for text in ("so...", "'yes,' a_,b ,_ x.%%% ½, (a.) .'s", "x,,y\u0301, z.", "\x1c, ¿a,b?.", "İ, Ȁ, x."):  # marks in a row are one
        assert np.frombuffer(words.ids(text), dtype=words.dtype).tolist() + [1] == encode(text)


# ---- 9: SimHash ----


def components_of(values, linked):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("n,leaf_rows,dense", [(1, 4, 0), (300, 8, 0), (300, 8, 250), (60, 1024, 40)])
def test_links_find_every_component(spark, n, leaf_rows, dense):
    rng = np.random.default_rng(n + dense)
    values = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    base = np.uint64(0xF0F0_1234_5678_9ABC)
    for k in range(dense):  # a dense ball, most of it sharing long prefixes
        values[k] = base ^ (np.uint64(1) << np.uint64(rng.integers(0, 16))) ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) ^ (np.uint64(1) << np.uint64(rng.integers(0, 30)))
    values = np.unique(values).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    found = components.connected_components(simhash.links(df, 2, leaf_rows)).collect()
    label = {r.node: r.component for r in found}
    roots = components_of(values.tolist(), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    mine = [label.get(int(v), int(v)) for v in values]
    assert len(set(zip(roots, mine))) == len(set(roots)) == len(set(mine))


def test_gray_rank_is_a_gray_order():
    codes = np.array([k ^ (k >> 1) for k in range(256)], dtype=np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(256))


def test_fingerprints_by_hand(spark, edge):
    from xxhash import xxh64_intdigest

    def slow(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        if not words:
            return 0
        h = [xxh64_intdigest(" ".join(words[k : k + 3]), seed=42) for k in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(edge).collect()}
    assert got == {(k if k != 4 else None): slow(t) for k, t in enumerate(EDGE_TEXTS)}


def test_near_duplicates_edges(spark, edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE_TEXTS) + 1
    label = {r.doc_id: r.component_id for r in rows}
    assert label[0] == label[1] == label[2] == 0 and label[7] == label[8] == 7 and label[None] is None
    kept = [r.doc_id for r in simhash.keep_one(edge).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 3, 5, 6, 7, 9, 10] and kept.count(None) == 1
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    rows = [(1, "first text of quite other words"), (1, "second text that nobody copies here"), (1, "second text that nobody copies here"), (0, "first text of quite other words")]
    rows += [(None, "a third one without an id"), (None, "a third one without an id"), (None, "first text of quite other words"), (None, "fourth text none has elsewhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert got == [(-1, "a third one without an id"), (-1, "fourth text none has elsewhere"), (0, "first text of quite other words"), (1, "second text that nobody copies here")]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges if a is not None and a != b for x in (a, b)})
    pairs = {frozenset(e) for e in edges}
    roots = components_of(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert got == {v: nodes[r] for v, r in zip(nodes, roots)}


# ---- 10: line dedup ----


def slow_line_dedup(docs, long_line=120):
    """The rule, window by window: pairs of consecutive lines that are not blank, and long lines, whose first occurrence is elsewhere."""
    split = {d: (t or "").split("\n") for d, t in docs}
    filled = {d: [i for i, x in enumerate(x) if x.strip(" ")] for d, x in split.items()}
    first, gone = {}, set()
    for d in sorted(split):
        lines = [split[d][i] for i in filled[d]]
        for k in range(len(lines)):
            for n in (1, 2):
                if k + n <= len(lines) and (n == 2 or len(lines[k]) >= long_line):
                    a, b = first.setdefault(tuple(lines[k : k + n]), (d, k))
                    if a != d or k - b >= n:
                        gone |= {(d, k + i) for i in range(n)}
    out = {}
    for d, x in split.items():
        owner = [sum(q <= p for q in filled[d]) - 1 for p in range(len(x))]
        out[d] = "\n".join(v for p, v in enumerate(x) if (d, owner[p]) not in gone)
    return out


def check_line_dedup(spark, docs):
    df = spark.createDataFrame([(k, t, 9, "x") for k, t in docs], "doc_id long, text string, n_chars int, t_lines string").repartition(5)
    out = line_dedup.remove_repeated_chunks(df)
    got, want = {r.doc_id: r for r in out.collect()}, slow_line_dedup(docs)
    assert {k: r.text for k, r in got.items()} == {k: want[k] if t is not None else None for k, t in docs}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.t_lines == "x" for r in got.values())
    assert all(r.lines_removed + r.lines_kept == len((dict(docs)[k] or "").split("\n")) for k, r in got.items())
    assert out.columns == ["doc_id", "text", "n_chars", "t_lines", "lines_removed", "lines_kept"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
    return want


def test_line_dedup_equals_the_loop(spark):
    rng = random.Random(4)
    pool = [f"line {k} " + "w " * rng.choice([1, 3, 80]) for k in range(30)] + ["", " ", ""]
    passage = "\n".join(pool[:6])
    docs = []
    for k in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"own {k} {i}" for i in range(rng.randint(0, 9))]
        docs.append((k, "\n".join(lines[:4] + ([passage] if k % 3 == 0 else []) + lines[4:])))
    check_line_dedup(spark, docs)


def test_whole_repeated_passages_go(spark):
    rng = random.Random(9)
    passages = [[f"passage {p} line {k} " + "w " * rng.choice([0, 5, 20, 90]) for k in range(n)] for p, n in enumerate([2, 3, 4, 8, 50, 4000])]
    docs = []
    for k in range(40):
        lines = [f"own {k} {i}" for i in range(6)] + ["a"] * rng.randint(0, 4)
        docs.append((k, "\n".join(lines[:3] + passages[k % 6] + lines[3:])))
    docs += [(50, None), (51, ""), (52, "one\n\none\n\none\n\none"), (53, "\n \nown 0 0\n\n\nown 0 1\n\nnew")]
    want = check_line_dedup(spark, docs)
    assert not any("passage" in want[k] for k in range(6, 40))
    assert want[52] == "one\n\none\n" and want[53] == "\n \nnew"


def test_line_dedup_edges(spark, edge):
    rows = line_dedup.remove_repeated_chunks(edge).collect()
    assert len(rows) == len(EDGE_TEXTS) + 1 and {r.doc_id: r.text for r in rows}[0] is None
    assert line_dedup.remove_repeated_chunks(edge.limit(0)).count() == 0
    clean = spark.createDataFrame([(1, "a\nb\nc"), (2, "d\ne\nf"), (3, "a")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.remove_repeated_chunks(clean).collect()} == {1: "a\nb\nc", 2: "d\ne\nf", 3: "a"}
    long = "word " * 60
    twice = spark.createDataFrame([(1, f"x\n{long}\ny"), (2, f"p\n{long}\nq\nr")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.remove_repeated_chunks(twice).collect()} == {1: f"x\n{long}\ny", 2: "p\nq\nr"}


def test_line_dedup_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.LINE_DEDUP_SQL).fetchall()
    got = queries.op10_line_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "lines_kept", "lines_removed", "text_md5"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pipeline_removes_whole_passages(spark):
    import corpus_pipeline

    passage = "\n".join(f"shared line {k}" for k in range(7))
    df = spark.createDataFrame([(k, f"top {k}\n{passage}\nend {k}") for k in range(4)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert got == {0: f"top 0\n{passage}\nend 0"} | {k: f"top {k}\nend {k}" for k in (1, 2, 3)}


# ---- 5, 6, 7: classifiers ----


def auc(labels, scores):
    pos, neg = [s for y, s in zip(labels, scores) if y], [s for y, s in zip(labels, scores) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_pair_term_equals_the_double_sum():
    rng = np.random.default_rng(0)
    m = quality_fm.FactorisationMachine(20, np.zeros((1, 1)), 0.3, rng.normal(size=40), rng.normal(size=(40, 4)))
    at, x = rng.choice(40, 9, replace=False), rng.random(9)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    assert m.raw_score(at, x) == pytest.approx(0.3 + m.linear[at] @ x + pairs)


def test_quality(spark):
    out = queries.op5_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert auc([r.quality for r in out], [r.score for r in out]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_classifiers_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_fm.train(edge, none)
    assert {r.score for r in quality_fm.score(edge, model).collect()} == {0.5} and quality_fm.accepted(edge, model).count() == len(EDGE_TEXTS) + 1
    grammar = toxicity.train(edge, none)
    assert all(r.score < 0.3 for r in toxicity.score(edge, grammar).collect()) and toxicity.accepted(edge, grammar).count() == len(EDGE_TEXTS) + 1
    filters = langid.train(edge.filter("lang IS NULL"))
    assert {r.lang_pred for r in langid.predict(edge, filters).collect()} == {"und"}
    one = quality_fm.train(edge, spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int"))
    assert all(r.score > 0.99 for r in quality_fm.score(edge, one).collect())
    assert quality_fm.score(edge.limit(0), one).count() == 0 and toxicity.score(edge.limit(0), grammar).count() == 0


def test_grammar_weighs_clauses():
    g = toxicity.ToxicityGrammar({"idiot": 1.0}, {"lowei": 1.0})
    lexer = g.lexer()
    w = lexer.weight
    assert w("you are such an idiot.") > w("you are an idiot.") > w("an idiot.") > w("you are not an idiot.") > 0
    assert w("she said you are an idiot.") < w("you are an idiot.")
    assert w("i will kill you") > 0 and w("i will kill time") == 0 and w("you and them") == 0
    assert w("LOWEIxyz!!!") == w("an idiot.")
    assert [c[:2] for c in lexer.clauses("fine words here. you idiot, go on")] == [(3, 7)]  # a comma ends no clause


def test_clauses_end_at_sentences_and_lines():
    g = toxicity.ToxicityGrammar(dict.fromkeys(toxicity.SEED_INSULTS.split(), 1.0), {})
    w = g.lexer().weight
    assert w("she said, you are an idiot.") == w('she said: "you are an idiot."') == w("she said you are an idiot.") < w("you are an idiot.")
    assert w("first line has idiot\nyou second line") == w("first line has idiot") < w("first line has idiot you")
    assert w('"you are wrong." an idiot') == w("an idiot")
    assert g.score_of(w("idiot")) < 0.3 <= g.score_of(w("you are an idiot"))
    assert all(g.score_of(w(t)) >= 0.3 for t in ("du bist ein Trottel!", "tu es un crétin", "usted es un imbécil"))


def test_the_product_equals_its_parts():
    rng, weights = random.Random(8), toxicity.WEIGHTS
    for _ in range(500):
        symbols = [(rng.randrange(7), rng.choice([0.5, 1.0, 2.0])) for _ in range(rng.randint(0, 12))]
        states, waiting, total = [0] * len(toxicity.PARTS), None, 0.0  # waiting: an attack that has no target yet
        for symbol, lexical in symbols:
            marks = []
            for k, part in enumerate(toxicity.PARTS):
                states[k], mark = part(states[k], symbol)
                marks.append(mark)
            negated, reported, aimed, boosted = marks
            scope = weights["negated"] * negated + weights["reported"] * reported
            if symbol == toxicity.INSULT:
                total += max(0.05, weights["insult"] + weights["target"] * aimed + weights["boost"] * boosted + scope) * lexical
                waiting = "done" if aimed else "target"
            elif symbol == toxicity.THREAT and waiting is None:
                waiting = scope
            elif symbol == toxicity.TARGET and waiting == "target":
                total, waiting = total + weights["target"], "done"
            elif symbol == toxicity.TARGET and isinstance(waiting, float):
                total, waiting = total + max(0.05, weights["threat"] + waiting), "done"
        assert toxicity.Automaton().weigh(symbols) == pytest.approx(total)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op6_toxicity(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    caught, flagged, toxic = sum(r.predicted and r.toxic for r in rows), sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    print("toxicity held out:", toxic, "toxic,", len(rows) - toxic, "clean;", caught, "caught,", flagged - caught, "clean ones flagged")
    assert auc([r.toxic for r in rows], [r.score for r in rows]) > 0.95
    assert caught >= 0.9 * toxic and flagged - caught <= 0.02 * (len(rows) - toxic)


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):  # each language has syllables of its own
        syllables = ["".join(rng.choices(alphabet, k=4)) for _ in range(12)]
        rows += [(k * 20 + d, " ".join("".join(rng.choices(syllables, k=2)) for _ in range(40)), f"l{k:02d}") for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(docs, learn=langid.learn_fold(4, 2))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, filters).collect()}
    assert filters.table.shape[0] == 2 and sum(got[d] == name for d, _, name in rows) > 0.98 * len(rows)


def test_language(spark, edge):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    filters = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(edge, filters).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())


def test_filters_hold_every_ngram():
    table, bits = np.zeros(1 << 12, dtype=np.uint64), 12
    g = next(langid.grams("the quick brown fox"))
    for at in langid.slots_of(g, bits):
        np.bitwise_or.at(table, at.astype(np.int64), np.uint64(1))
    f = langid.LanguageFilters(("en",), bits, table, np.array([0.0]))
    assert f.hits("the quick brown fox") == (np.array([len(g)]), len(g))
    assert F is not None
