"""Alignment, pieces and resampling against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from takeup.llm import alignment, pieces, resampling

SCHEMA = "doc_id long, text string, id string, _text string, rank int, n_docs string, score string"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", " \n\t ", "a", "▁x", "a ▁ b", "<s> </s> <unk> <0x41> <|endoftext|>", "日本語 𓀀𓀁 🙂", "ΟΔΟΣ'Α b c9d", "\u0000x\ty  z ", "É" * 30]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    names = ["".join(rng.choice(list("abcdeioutrnsé"), rng.integers(1, 9))) for _ in range(60)]
    return " ".join(rng.choice(names, n))


@pytest.fixture(scope="module")
def rows():
    texts = ODD + [prose(i, 5 + 7 * i) for i in range(20)] + [prose(50, 30_000), "x" * 5000]
    out = [(i, t, "i", "t", i, "n", "s") for i, t in enumerate(texts)]
    return out + [out[14], out[14], (None, prose(3, 40), "", "", 0, "", ""), (16, prose(60, 40), "", "", 0, "", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 12 ---------------------------------------------------------------------------

def test_pieces_match_the_library(docs, rows):
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_texts(docs, PIECES).collect()
    want = []
    for i, text, *_ in rows:
        coded = whole.encode(text or "", out_type="proto").pieces
        ids = [p.id for p in coded]
        want.append((i, tuple(ids), tuple(p.begin for p in coded), tuple(p.end for p in coded), whole.decode(ids) if ids else ""))
    assert collections.Counter(want) == collections.Counter((r.doc_id, tuple(r.ids), tuple(r.begins), tuple(r.ends), r.decoded) for r in got)
    report = pieces.piece_report(docs, PIECES).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in report) == collections.Counter(
        (i, len(ids), digest(",".join(map(str, ids))), digest(text)) for i, ids, _, _, text in want)


@pytest.mark.parametrize("options", [{}, {"remove_extra_whitespaces": False}, {"add_dummy_prefix": False}, {"escape_whitespaces": False}])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_maps_match_the_library(rule, options):
    """The longest prefix found in a compiled map, and the spans projected through it, are the library's."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(pieces.read_model(PIECES))
    model.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, **options).serialized_normalizer_spec())
    raw = model.SerializeToString()
    whole, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Encoder(raw)
    for text in [t or "" for t in ODD] + ["ＡＢＣ  ﬁx ① ㌔ é 각", "  a  b  ", "Straße ẞ İ　x", "zero­​", "日本 ﾊﾟ ﷺ", prose(1, 200)]:
        coded = whole.encode(text, out_type="proto").pieces
        ids, begins, ends = own.encode(text)
        assert own.aligned(text)[0].decode() == whole.normalize(text)
        assert [(p.id, p.begin, p.end) for p in coded] == list(zip(ids.tolist(), begins.tolist(), ends.tolist()))


def test_user_pieces_and_unknown_pieces():
    """Own pieces are kept whole, also those with white space inside; without byte pieces unknown text has one piece."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(pieces.read_model(PIECES))
    model.pieces.add(piece="<mark>", type=4, score=0)
    for p in model.pieces:
        if p.type == 6:
            p.type = 1
    model.trainer_spec.byte_fallback = False
    raw = model.SerializeToString()
    whole, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Encoder(raw)
    for text in ["a<mark>b <mark> c", "𓀀𓀁 x 𓀀", "日本語"]:
        coded = whole.encode(text, out_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in coded] == list(zip(*(v.tolist() for v in own.encode(text))))


def test_pieces_of_nothing(none):
    assert pieces.piece_report(none, PIECES).count() == 0


# -- 11 ---------------------------------------------------------------------------

def brute_alignment(rows):
    """All groups, links and corpus counts, pair by pair."""
    first, second = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def piece(k):
        p = second.id_to_piece(k)
        return bytes([int(p[3:-1], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode()

    found = []
    for i, text, *_ in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a, bytes_b = [bytes(letters[c] for c in first.id_to_token(k)) for k in a], [piece(k) for k in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist() if a else [], np.cumsum([len(x) for x in bytes_b]).tolist() if b else []
        cuts = sorted(set(ends_a) & set(ends_b))
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        parts = [([], []) for _ in cuts]
        for k, g in zip(a, group_a):
            parts[g][0].append(str(k))
        for k, g in zip(b, group_b):
            parts[g][1].append(str(k))
        links = []
        for g in range(len(cuts)):
            for x in np.flatnonzero(group_a == g):
                for y in np.flatnonzero(group_b == g) if len(a) < 3000 else range(*np.searchsorted(group_b, [g, g + 1])):
                    if max(ends_a[x] - len(bytes_a[x]), ends_b[y] - len(bytes_b[y])) < min(ends_a[x], ends_b[y]):
                        links.append((a[x], b[y]))
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in parts)
        found.append((i, len(a), len(b), len(cuts), links, digest(text) if a else ""))
    count = collections.Counter(pair for f in found for pair in set(f[4]))
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(i, na, nb, ng, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), text)
            for i, na, nb, ng, links, text in found]


@pytest.fixture(scope="module")
def small(rows):
    return [r for r in rows if len(r[1] or "") < 20_000]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_alignment(spark, small, frequent):
    got = alignment.alignment_report(spark.createDataFrame(small, SCHEMA), BYTES, PIECES, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(brute_alignment(small)) == collections.Counter(tuple(r) for r in got.collect())


def test_alignment_of_a_long_text_and_of_nothing(spark, rows, none):
    long = [r for r in rows if len(r[1] or "") >= 20_000]
    got = alignment.align_texts(spark.createDataFrame(long, SCHEMA), BYTES, PIECES).collect()
    for r in got:
        assert r.a_ends[-1] == len(r.a_ids) and r.b_ends[-1] == len(r.b_ids) and len(r.a_ends) == len(r.b_ends)
    report = alignment.alignment_report(spark.createDataFrame(long, SCHEMA), BYTES, PIECES).first()
    assert report.n_groups == len(got[0].a_ends) and report.n_best == report.n_links
    assert alignment.alignment_report(none, BYTES, PIECES).count() == 0


def test_runs_are_jumped_exactly():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = sorted(set(rng.integers(1, n + 1, n).tolist()) | {n}), sorted(set(rng.integers(1, n + 1, n).tolist()) | {n})
        rest, cuts = np.array(alignment.irregular_groups(np.array(a), np.array(b)), dtype=np.int64).reshape(-1, 4), set(a) & set(b)
        i = j = 0
        for i0, x, j0, y in [*rest.tolist(), (len(a), len(a), len(b), len(b))]:
            assert a[i:i0] == b[j:j0]  # one to one up to the group
            if i0 < x:
                assert a[x - 1] == b[y - 1] and not cuts & set(a[i0:x - 1]) and (x - i0, y - j0) != (1, 1)
            i, j = x, y
        assert (i, j) == (len(a), len(b))
        link_a, link_b = alignment.walk(np.array(a), np.array(b), rest)
        want = [(p, q) for i, x, j, y in rest.tolist() for p in range(i, x) for q in range(j, y)
                if max(([0] + a)[p], ([0] + b)[q]) < min(a[p], b[q])]
        assert sorted(want) == sorted(zip(link_a.tolist(), link_b.tolist()))
    assert alignment.run_length(np.arange(1000).tobytes(), 0, np.array([*range(700), *range(5000, 5300)]).tobytes(), 0) == 700


def test_very_long_white_space_and_words(spark):
    """Beyond what the quick reader bears the other library reads; words without any space are one long merge."""
    rows = [(1, "a" + " " * 300_000 + "b", "", "", 0, "", ""), (2, "\n" * 40_000, "", "", 0, "", ""), (3, "ab" * 60_000, "", "", 0, "", "")]
    got = {r.doc_id: r for r in alignment.alignment_report(spark.createDataFrame(rows, SCHEMA), BYTES, PIECES).collect()}
    for i, *want in brute_alignment(rows):
        assert [got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links, got[i].n_best, got[i].count_sum, got[i].groups_sha256] == want


def test_cut_keeps_the_broadcast_bounded(spark):
    counts = spark.createDataFrame([(k, 1 + k // 10) for k in range(500)], "pair long, n_docs long")
    for most in (0, 7, 100, 499, 500):
        cut = alignment.frequent_cut(counts, most)
        assert counts.where(F.col("n_docs") >= cut).count() <= most
    assert alignment.frequent_cut(counts, 500) == 1


# -- 13 ---------------------------------------------------------------------------

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_resampling(rows, items, percent, most=2, buckets=10_000):
    def features(text):
        words = WORDS.findall(lower(text))
        return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t, *_ in rows]
    s, t = collections.Counter(b for f in found for b in f[2]), collections.Counter(b for _, x in items for b in features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, n, own in found:
        gains = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    place = collections.defaultdict(list)
    for k, r in enumerate(able, 1):
        place[tuple(r)].append(k if k <= len(able) * percent // 100 else None)
    return [(*r[:4], place[tuple(r)].pop() if r[4] >= 20 else None) for r in out]


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resampling(spark, docs, rows, percent):
    items = [("b1", prose(2, 60)), ("b2", None), ("b3", "")]
    target = spark.createDataFrame(items, "item_id string, text string")
    got = [tuple(r) for r in resampling.resample(docs, target, percent=percent).drop("n_words").collect()]
    assert collections.Counter(got) == collections.Counter(brute_resampling(rows, items, percent))


def test_resampling_with_many_equal_rows_and_longer_grams(spark, rows):
    many = rows + [rows[13]] * 300 + [(None, prose(3, 40), "", "", 0, "", "")] * 50
    items = [("b", "The same words again " * 5)]
    got = resampling.resample(spark.createDataFrame(many, SCHEMA), spark.createDataFrame(items, "item_id string, text string"), most=3, percent=60)
    assert collections.Counter(brute_resampling(many, items, 60, 3)) == collections.Counter(tuple(r) for r in got.drop("n_words").collect())


def test_resampling_without_documents_or_target(spark, docs, rows, none):
    target = spark.createDataFrame([], "item_id string, text string")
    assert resampling.resample(none, target).count() == 0
    got = [tuple(r) for r in resampling.resample(docs, target).drop("n_words").collect()]
    assert collections.Counter(got) == collections.Counter(brute_resampling(rows, [], 25))


def test_shift_of_long_spans():
    shift, body = resampling.ZeroShift(), np.random.default_rng(3).integers(0, 256, 70_001, dtype=np.uint8).tobytes()
    for a, b in ((0, 70_001), (1, 70_000), (5, 6), (123, 65_659)):
        crc = np.array([zlib.crc32(body[:a])], dtype=np.uint32)
        assert int(np.uint32(zlib.crc32(body[:b])) ^ shift(crc, np.array([b - a]))[0]) == zlib.crc32(body[a:b])


# -- 7 ----------------------------------------------------------------------------

def test_training_rows_are_bounded_where_many_documents_share_a_labelled_id(spark):
    """A plain follow-the-leader over one document per labelled id gives the same weights."""
    from takeup.llm import quality_model

    many = [(i % 40, prose(i, 30) + (" good" if i % 2 else " bad")) for i in range(200)] + [(7, prose(900 + i, 30)) for i in range(300)] + [(41, None)]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    marks = [(i, i % 2, 0) for i in range(42)] + [(3, 1, 0), (3, 1, 1), (None, 1, 0), (5, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality_model.train(docs, labels, "doc_id", "text", "quality", bits=12, epochs=2)

    order = {i: spark.sql(f"select xxhash64({i}L)").first()[0] for i in range(42)}
    by_id = collections.defaultdict(list)
    for i, text in many:
        by_id[i].append(text)
    model, rows = quality_model.FollowTheLeader(12), []
    for i in sorted({i for i, y, _ in marks if i is not None and y is not None and zlib.crc32(str(i).encode()) % 4 != 2}, key=order.get):
        vectors = [quality_model.features(t, 12) for t in by_id.get(i, [])]
        if vectors:
            hashes = [spark.createDataFrame([([int(p) for p in v[0]],)], "p array<long>").selectExpr("xxhash64(p)").first()[0] for v in set_of(vectors)]
            rows.append((set_of(vectors)[int(np.argmin(hashes))], i % 2))
    for _ in range(2):
        for (places, values), y in rows:
            model.learn(places.astype(np.int32), values.astype(np.float32), y)
    assert np.count_nonzero(got) > 50 and got == pytest.approx(model.weights(slice(None)), abs=1e-6)


def set_of(vectors):
    return list({tuple(v[0].tolist()): v for v in vectors}.values())
