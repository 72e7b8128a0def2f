"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeup.llm import (chat, decontamination, mixing, pii, quality_model, quality_rules, secrets, simhash, url_rules, warc)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, row string, w string, id string"
SPACE = re.compile("[^\x20\x09-\x0D]+")
LETTERS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    names = ["".join(rng.choice(list("abcdeioutrnsé"), 5)) for _ in range(400)]
    return " ".join(rng.choice(names, n))


def documents():
    rows, texts = [], [prose(i, 80) for i in range(40)]
    texts += [texts[0]] * 3 + [texts[1] + " more", "", None, " \n\t ", "one", "two words", "ΟΔΟΣ'Α " + texts[2], prose(99, 30_000)]
    texts += ["# " * 60 + texts[3], "\n".join([texts[4][:60]] * 12), 'token = "abcdef0123456789abcd" AKIA' + "Z9" * 8 + " 0123456789abcdef0"]
    for i, t in enumerate(texts):
        rows.append((i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", i, i, "x", "y", "z"))
    rows += [rows[3], rows[3], (None, texts[5], "en", "s1", 0, 0, "x", "y", "z"), (8, "another text under the same id " + texts[6], "en", "s0", 1, 2, "", "", "")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id long, text string")
    for frame in (quality_rules.quality_report(none), quality_rules.keep_good(none), simhash.near_duplicates(none),
                  simhash.keep_one(none), decontamination.contamination(none, items), mixing.mix_report(none),
                  mixing.mix_documents(none), secrets.secret_report(none), secrets.redact(none), pii.pii_report(none)):
        assert frame.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.score_quality(none, labels).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_rules.judge_urls(pages, labels).count() == 0
    assert warc.archive_round_trip(pages).count() == 0
    assert chat.chat_report(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# -- 4 ----------------------------------------------------------------------------

def test_quality_counts(docs, rows):
    def brute(text):
        words = SPACE.findall(text or "")
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        mark = [0] * len(words)
        for i, k in enumerate(zip(words, words[1:], words[2:])):
            if seen[k] > 1:
                mark[i] = mark[i + 1] = mark[i + 2] = 1
        lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
        return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(mark))

    got = quality_rules.quality_report(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter((r[0], *brute(r[1])) for r in rows)
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(1, 40)) <= kept and 51 not in kept  # prose stays, symbols go
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_sketches_merge_and_bound_quantiles(spark):
    values = [int(v) for v in np.random.default_rng(1).integers(0, 100_000, 4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").selectExpr(
        "'a' as lang_key", "cast(v % 2 as string) as source_key", "'r' as rule", f"{quality_rules.cell('v')} as cell")
    cells = df.groupBy("lang_key", "source_key", "rule", "cell").agg(F.count("*").alias("n"))
    row = quality_rules.quartiles(quality_rules.merge(cells, ["lang_key"]), ["lang_key"]).first()
    assert row.documents == len(values)
    for got, q in ((row.q1, 0.25), (row.q3, 0.75)):
        exact = sorted(values)[int(np.ceil(q * len(values))) - 1]
        assert got <= exact <= got * 33 / 32 + 1


# -- 10 ---------------------------------------------------------------------------

def brute_simhash(text):
    import xxhash

    words = SPACE.findall(ascii_lower(text))
    items = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in items) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(items))


def brute_components(values, distance):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_near_duplicates(docs, rows):
    prints = [brute_simhash(r[1]) for r in rows]
    root = brute_components(prints, 2)
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[root[i]] = min(first.get(root[i], r[0]), r[0])
    want = collections.Counter((r[0], format(prints[i], "016x"), first.get(root[i])) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")).alias("h"), "component_id").collect()
    assert want == collections.Counter(map(tuple, got))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))


@pytest.mark.parametrize("leaf_size", [4096, 64, 4])
def test_links_of_dense_clusters(spark, leaf_size):
    rng = np.random.default_rng(leaf_size)
    values = {int(v) for v in rng.integers(0, 1 << 63, 150)}
    centre = int(rng.integers(0, 1 << 63))
    for i in range(64):  # a star of near copies, then a chain
        values.add(centre ^ 1 << i)
    chain = int(rng.integers(0, 1 << 63))
    for i in range(0, 60, 2):
        chain ^= 3 << i
        values.add(chain)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fp long, id long")
    got = {r.id: r.component_id for r in simhash.cluster(df, "id", 2, leaf_size).collect()}
    root = brute_components([v & (1 << 64) - 1 for v in values], 2)
    assert got == dict(enumerate(root))


def test_index_search_finds_all():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 20, 500).astype(np.uint64)
    members = np.unique(base)
    members = members[np.argsort(simhash.gray_rank(members))]
    who, found = simhash.search(members, members[:50], 2)
    want = {(i, j) for i in range(50) for j in range(len(members)) if int(members[i] ^ members[j]).bit_count() <= 2}
    assert set(zip(who.tolist(), found.tolist())) == want


# -- 9 ----------------------------------------------------------------------------

def test_contamination(spark, docs, rows):
    texts = [r[1] for r in rows]
    items = [(1, " ".join(texts[0].split()[5:40])), (2, " ".join(texts[0].split()[20:32]).upper()), (3, None), (4, ""),
             (5, "ὈΔΟΣ'Α " + texts[2][:60]), (6, "ΟΔΟΣ'Α " + texts[2][:90]), (7, "two words"), (8, texts[7].split()[3]),
             (2, " ".join(texts[9].split()[:10])), (None, " ".join(texts[9].split()[30:45]))]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = LETTERS.findall(ascii_lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add("" if i is None else str(i))
    want = collections.Counter()
    for r in rows:
        w, hit, found = LETTERS.findall(ascii_lower(r[1])), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    found |= windows[tuple(w[k:k + n])]
                    hit |= set(range(k, k + n))
        want[(r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, table).drop("_k1", "_k2").collect()
    assert want == collections.Counter(map(tuple, got))
    clean = decontamination.keep_clean(docs, table)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for k, n in want.items() if not k[5])


# -- 5 ----------------------------------------------------------------------------

def test_secret_spans(docs, rows):
    patterns = {"assign": (secrets.BASE["assign"][0], 2, 12), "access": ("AKIA[A-Z0-9]+", 0, 18), "hex": ("[0-9a-f]+", 0, 16)}
    want = collections.Counter()
    for r in rows:
        spans = sorted((m.start(), n, m.end(), k) for n, (k, (p, g, least)) in enumerate(patterns.items())
                       for m in re.finditer(p, r[1] or "") if len(m[g]) >= least)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want[(r[0], *[sum(s[3] == k for s in spans) for k in patterns], hashlib.sha256(text.encode()).hexdigest())] += 1
    got = secrets.secret_report(docs).drop("spans").collect()
    assert want == collections.Counter(map(tuple, got))
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where("text like '%AKIA%' or text like '%abcdef0123%'").count() == 0
    untouched = [r for r in rows if not (r[1] and "AKIA" in r[1])]
    assert clean.where("text is null or text not like '%[SECRET]%'").count() == len(untouched)


def test_automaton_learns_a_format():
    rng = np.random.default_rng(5)
    draw = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    model = secrets.Automaton([draw() for _ in range(200)])
    assert len(model.step) > 1
    assert np.mean([model.accepts(draw()) for _ in range(200)]) > 0.85
    assert not any(model.accepts(v) for v in ("ThisIsJustALongIdentifierName0", "snake_case_identifier_number_12", "=" * 39 + "a1"))


@pytest.mark.parametrize("form", ["letters", "dotted", "digits"])
def test_learned_formats_without_their_keyword(form):
    rng = np.random.default_rng(8)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    make = {"letters": lambda: draw(letters, 13), "dotted": lambda: draw(letters, 6) + "." + draw(digits, 6),
            "digits": lambda: draw(digits, 12)}[form]
    words = ["".join(rng.choice(["inter", "nation", "al", "ization", "form", "ation", "char", "acter", "istic", "respons"], 4))
             for _ in range(600)]
    words = [w for w in words if len(w) >= 12]
    model = secrets.Automaton([make() for _ in range(200)])
    hidden = [make() for _ in range(50)]
    tokens = [s[3] for t in hidden + words for s in secrets.scan(f"so {t} is left")[1]]
    assert set(hidden + words) <= set(tokens)
    ordinary = secrets.Background(tokens)
    assert np.mean([model.accepts(h, ordinary.score(h)) for h in hidden]) > 0.8
    assert np.mean([model.accepts(w, ordinary.score(w)) for w in words]) < 0.01


def test_partly_covered_tokens_and_short_ones_are_candidates():
    assert secrets.scan("hunter2hunt3r")[1] == [("inferred", 0, 13, "hunter2hunt3r")]
    assert ("inferred", 4, 32, "ghp_0123456789abcdef0123XYZQ") in secrets.scan("key ghp_0123456789abcdef0123XYZQ")[1]
    assert secrets.scan("password=hunter2hunt3r")[1] == []


def test_rare_formats_share_an_automaton(spark):
    texts = [f"AKIA{'Q7' * 6}{i}{i}" for i in range(10, 13)] + [f"token={'Kq3' * 4}{i}" for i in range(3)]
    rows = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert set(secrets.train(rows)) == {"pooled"}


def spans_table(spark, column, spans):
    """A scanned table with the values ``(kind, value)`` in one column of spans, some of them twice."""
    rows = [([(k, 0, len(v), v)] * (1 + i % 2),) for i, (k, v) in enumerate(spans)]
    return spark.createDataFrame(rows, f"{column} {secrets.SPAN}").repartition(4)


def test_ordinary_tokens_are_counted_from_all_candidates(spark):
    rng = np.random.default_rng(11)
    values = ["".join(rng.choice(list("abcdeXY09+/._=-"), 12)) for _ in range(4500)] + ["q" * 129 + "Z", "z" * 70_000]
    want = secrets.Background(values)
    got = secrets.background(spans_table(spark, "others", [("inferred", v) for v in values]))
    assert (got.pairs, got.seen) == (want.pairs, want.seen)
    assert all(got.score(v) == want.score(v) for v in values[:50] + values[-2:])


def test_automata_count_all_values(spark):
    """More values than a driver's sample would hold, long ones and a pooled rest; threshold and counts by brute force."""
    rng = np.random.default_rng(12)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    spans = [("assign", "ghp_" + draw("abcdefghijklmnopqrstuvwxyz0123456789", 20)) for _ in range(1500)]
    spans += [("assign", draw("0123456789ABCDEF", 140)) for _ in range(300)] + [("assign", "x" * 20_000)]
    spans += [("access", "AKIA" + draw("ABCDEFGHIJ0123456789", 16)) for _ in range(3)]
    models = secrets.train(spans_table(spark, "base", spans))
    assert set(models) == {"assign", "pooled"}
    for name, model in models.items():
        values = sorted({v for k, v in spans if name == "pooled" or k == name})
        scores = sorted(model.score(v) for v in values)
        assert model.least == scores[int(0.05 * len(scores))]
        assert sum(model.ended) == len(values) and sum(model.seen) == sum(len(v) + 1 for v in values)
        assert model.seen[0] >= len(values) and len(model.step) > 1
    assert all(models["assign"].passed[0].get(c, 0) for c in "lHd")
    fresh = ["ghp_" + draw("abcdefghijklmnopqrstuvwxyz0123456789", 20) for _ in range(100)]
    assert np.mean([models["assign"].accepts(v) for v in fresh]) > 0.85
    assert not any(models["assign"].accepts(v) for v in ("ThisIsJustALongIdentifierName0", "=" * 39 + "a1"))


def merged_states(words):
    """The states learned from strings of classes with their counts, by brute force over all prefixes."""
    step = [{}]
    while True:
        seen = collections.defaultdict(collections.Counter)  # by state, or by open transition and prefix behind it
        for word, n in words.items():
            at = 0
            for i, s in enumerate(word):
                seen[at][s] += n
                if s not in step[at]:
                    for j in range(i + 1, len(word) + 1):
                        seen[(at, s), word[i + 1:j]][word[j:j + 1]] += n
                    break
                at = step[at][s]
            else:
                seen[at][""] += n

        def differ(a, b):
            n, m = sum(a.values()), sum(b.values())
            bound = n and m and math.sqrt(0.5 * math.log(2 / 0.05)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            return bool(bound) and any(abs(a[s] / n - b[s] / m) > bound for s in {*a, *b})

        def reached(state, way):
            for i, s in enumerate(way):
                if s not in step[state]:
                    return (state, s), way[i + 1:]
                state = step[state][s]
            return state

        prefixes = [k for k in seen if isinstance(k, tuple)]
        left, known, grown = sorted({b for b, _ in prefixes}), len(step), False
        if not left:
            return step, {q: dict(c) for q, c in seen.items()}
        same = {b: [r for r in range(known) if not any(differ(seen[k], seen.get(reached(r, k[1]), collections.Counter()))
                                                       for k in prefixes if k[0] == b)] for b in left}
        for q, s in left:
            if same[q, s]:
                step[q][s] = same[q, s][0]
            elif not grown:
                step[q][s], grown = len(step), True
                step.append({})


def test_states_merge_over_all_prefixes(spark):
    rng = np.random.default_rng(15)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    spans = [("assign", "sk-" + draw("abcdxyzXYZ019", 15)) for _ in range(120)] + [("assign", draw("0123456789", 12)) for _ in range(60)]
    spans += [("assign", "=" + draw("AZ", 3) + "." + draw("09", 9)) for _ in range(9)] + [("assign", "x" * 3000)]
    spans += [("hex", draw("0123456789abcdef", 40)) for _ in range(80)]
    models = secrets.train(spans_table(spark, "base", spans))
    for name, model in models.items():
        words = collections.Counter("".join(c for c, _ in secrets.classes(v)) for v in {v for k, v in spans if k == name})
        step, seen = merged_states(words)
        assert model.step == step
        for q, counts in seen.items():
            assert counts == {**model.passed[q], **({"": model.ended[q]} if model.ended[q] else {})}
    assert len(models["assign"].step) > 10


def test_prefixes_of_single_values_stay_in_their_task(spark, monkeypatch):
    """Six hundred different strings of sixty symbols: of their 36,000 prefixes few belong to two, and only those leave the walk."""
    rng, made = np.random.default_rng(16), spark.sparkContext.accumulator(0)
    words = sorted({"".join(rng.choice(list("dh"), 60)) for _ in range(600)})
    frame = type(spark.range(0))

    def counting(self, walk, schema, original=frame.mapInArrow):
        def counted(batches):
            for batch in walk(batches):
                made.add(batch.num_rows if "near" in batch.schema.names else 0)
                yield batch

        return original(self, counted, schema)

    monkeypatch.setattr(frame, "mapInArrow", counting)
    model = secrets.Automaton()
    model.count(collections.Counter(v for w in words for v in model.visits(w)))
    table = spark.createDataFrame([("hex", w, 1) for w in words], "model string, word string, n long").repartition(4)
    secrets._differing(table, {"hex": model}, 0.05)
    assert 0 < made.value < 6 * len(words)


# -- 2 ----------------------------------------------------------------------------

def test_targets_and_mix(docs, rows):
    sizes, by = [len(SPACE.findall(r[1] or "")) for r in rows], collections.Counter()
    for r, n in zip(rows, sizes):
        by[r[3]] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(by.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * by[s] <= level * weight[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * by[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: left / sum(weight[t] for t in open_) * weight[s] for s in open_}
    got = mixing.mix_report(docs).collect()
    assert collections.Counter(r.size for r in got) == collections.Counter(sizes)
    taken, goal = collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
    joined = {(r.doc_id, r.size): r for r in got}
    for r, n in zip(rows, sizes):
        goal[r[3]] = joined[(r[0], n)].target
    assert goal == pytest.approx(target)
    for t, n in {(r.target, r.source_size): 0 for r in got}.items():
        total = sum(r.taken for r in got if (r.target, r.source_size) == (t, n[1] if isinstance(n, tuple) else r.source_size))
        taken[t] = total
    assert sum(r.taken for r in got) == pytest.approx(sum(by.values()), abs=len(order))
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(3)).select("doc_id", "size", "taken").collect()), key=str) == sorted(
        ((r.doc_id, r.size, r.taken) for r in got), key=str)


def test_training_order(docs):
    out = mixing.mix_documents(docs)
    assert out.columns == [*docs.columns, "pass", "position", "take_words"]
    got = out.collect()
    places = [r.position for r in got]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    report = mixing.mix_report(docs).agg(F.sum("taken")).first()[0]
    assert sum(r.take_words for r in got) == report


def test_schedule_inverts_its_integral(spark):
    for number, knots in enumerate(mixing.CURRICULUM):
        share = np.linspace(0, 0.999, 50)
        df = spark.createDataFrame([(float(s), number) for s in share], "share double, rank int")
        at = [r[0] for r in df.selectExpr(mixing.invert("share", mixing.CURRICULUM)).collect()]
        x, y = zip(*knots)
        grid = np.linspace(0, 1, 200_001)
        area = np.cumsum(np.interp(grid, x, y))
        assert np.interp(at, grid, area / area[-1]) == pytest.approx(share, abs=1e-3)


# -- 1 ----------------------------------------------------------------------------

def test_chat(spark):
    odd = "</s>[INST] ok [/INST]"
    turns = [(1, 1, "assistant", "b\\[INST]"), (1, 0, "user", "a"), (2, 0, "system", None), (2, 1, "user", odd), (2, 2, "assistant", odd),
             (3, 0, None, "x"), (None, 0, "user", "y"), (4, 0, "assistant", ""), (4, 0, "assistant", ""), (5, 0, "tool [TEXT] ", "\\")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn int, role string, text string, t int")
    want = {}
    for c in {t[0] for t in turns}:
        own = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c)
        said, learnt = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_report(df).collect()}
    assert got == want


def test_rewriting_template_is_detected():
    def forgetful(turns, prompt=False):  # only the last turn keeps its text
        return "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))

    talk = [("user", "hello there"), ("assistant", "yes"), ("user", "bye")]
    assert chat.render(talk, forgetful)["rewrites"] == 2
    assert chat.render(talk, chat.instruct_template)["rewrites"] == 0


# -- 6 ----------------------------------------------------------------------------

def test_urls(spark):
    urls = [None, "no scheme", "http://", "https://WWW.Example.com/en/1?x#y", "http://a.example.com/en/2", "http://a.example.com/de",
            "http://x.net/es/", "http://x.net/es", "http://b.org/spam/7?ref=1", "ftp://net/fr/q"]
    pages = [(i, u, "") for i, u in enumerate(urls)]
    pages += [(100 + i, f"http://h{i % 9}.org/{'spam' if i % 3 == 0 else 'news'}/{i}", "") for i in range(300)] + [(8, urls[8], "")]
    labels = [(100 + i, 0 if i % 3 == 0 else 1, 0) for i in range(300)] + [(0, None, None)]
    got = url_rules.judge_urls(spark.createDataFrame(pages, "page_id long, url string, tokens string"),
                               spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(pages)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == ("", "", None, "allow") and by[1] == ("", "", None, "allow")
    assert by[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[4][2:] == ("example.com/en/", "block") and by[5][2:] == ("com/", "allow")
    assert by[6][2:] == ("net/es/", "block") and by[7][2:] == (None, "allow") and by[9][2:] == ("net/fr/", "block")
    assert by[8][2:] == (None, "block") and by[101][3] == "allow" and by[100][3] == "block"


# -- 7 ----------------------------------------------------------------------------

def test_classifier(spark):
    rows = [(i, prose(i, 60) + (" bad worse" if i % 3 == 0 else " fine"), "x") for i in range(400)] + [(900, None, ""), (901, "", ""), (None, "z", "")]
    labels = [(i, int(i % 3 != 0)) for i in range(400)] + [(5000, 1), (7, None)]
    got = quality_model.score_quality(spark.createDataFrame(rows, "doc_id long, text string, score string"),
                                      spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    from zlib import crc32
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    good, bad = ([r.score for r in held if (r.doc_id % 3 != 0) == side] for side in (True, False))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


# -- 8 ----------------------------------------------------------------------------

@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    pages = [(i, f"http://a/{i}", f"<p>{prose(i % 20, 30)}</p>") for i in range(60)] + [(70, None, None), (71, "u", ""), (72, "a b", "ü\r\n\r\nx")]
    pages.append(pages[59])
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int").repartition(4)
    got = warc.archive_round_trip(df, min_bytes=least)
    assert got.where("error is not null").count() == 0
    by = collections.defaultdict(list)
    for p in pages:
        by[p[2] or ""].append(p[0])
    want = collections.Counter()
    for p in pages:
        body = (p[2] or "").encode()
        first = max(by[p[2] or ""])
        revisit = first != p[0] and len(body) >= least
        want[(p[0], len(body), warc.digest_of(body), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert want == collections.Counter(map(tuple, got.drop("error").collect()))


def test_damaged_archives_are_reported():
    import zstandard

    record = warc.format_record(1, "u", b"hello", None)
    frame = zstandard.ZstdCompressor().compress
    good = frame(record)
    assert [r["payload_bytes"] for r in warc.read_archive(good + warc.SEPARATOR.encode() + good)] == [5, 5]
    assert list(warc.read_archive(good[:-3]))[0]["error"].startswith("frame")
    for broken in (record.replace(b"Content-Length: 5", b"Content-Length: 6"), record.replace(b"WARC/1.1", b"WARX/1.1"),
                   record.replace(b"WARC-Date", b"Date"), record.replace(b"hello", b"hellO")):
        rows = list(warc.read_archive(frame(broken) + good))
        assert rows[0]["error"].startswith("record") and rows[1]["error"] is None
    compressed = warc.dictionary_frame(frame(b"x" * 100))
    assert len(list(warc.read_archive(compressed + good))) == 1


# -- 3 ----------------------------------------------------------------------------

def test_surrogates(spark):
    texts = ["mail Ann.Lee9@Mail.example.com or ANN.LEE9@MAIL.EXAMPLE.COM!! call +1 (017) 555-7713", "card 4539 1488 0343 6467 and 4539148803436467.",
             "10.20.30.40 met Frau Anna Müller. Then Frau Müller left, Herr Иван Петров came", None, "", "nothing here", "123-45-6789 DE44 5001 0517 5407 3249 31"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, values int")
    got = pii.pii_report(df, "k").collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.text, r.n_entities))
    assert all(len(v) == 1 for v in by.values())
    text = {k: next(iter(v))[0] for k, v in by.items()}
    assert text[3] is None and text[4] == "" and text[5] == texts[5]
    mail = re.fullmatch(r"mail (\S+@\S+) or (\S+@\S+)!! call (\+1 \(\d{3}\) \d{3}-\d{4})", text[0])
    assert mail[1].upper() == mail[2] and "ann" not in mail[1].lower()
    cards = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})\.", text[1])
    assert cards[1].replace(" ", "") == cards[2] != "4539148803436467"
    digits = [int(c) for c in reversed(cards[2])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    names = re.fullmatch(r"(\S+) met Frau (\S+) (\S+)\. Then Frau (\S+) left, Herr (\S+) (\S+) came", text[2])
    assert names[3] == names[4] and names[2].endswith("ia") and re.fullmatch("[а-яА-Я]+", names[5])
    assert not set("Anna Müller Иван Петров 10.20.30.40".split()) & set(names.groups())
    assert pii.pii_report(df, "other key").where("doc_id = 0").first().text != text[0]


def test_letters_beyond_ascii_and_other_phone_forms(spark):
    texts = ["x josé.garcia@x.es y", "x josé@x.es y", "x ana@bücher.de y", "call 555-123-4567.", "call +1.212.555.1234!", "or 555.123.4567 now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(df, "k").collect()}
    assert [got[i].n_entities for i in range(6)] == [1] * 6
    for i in range(3):
        assert re.fullmatch("x [a-z.]+@[a-z.]+ y", got[i].text) and len(got[i].text) == len(texts[i])
        assert not re.search("jos|garcia|ana|cher", got[i].text)
    assert re.fullmatch(r"call 5\d\d-\d{3}-\d{4}\.", got[3].text) and re.fullmatch(r"call \+1\.\d{3}\.\d{3}\.\d{4}!", got[4].text)
    assert re.fullmatch(r"or 5\d\d\.\d{3}\.\d{4} now", got[5].text) and all(got[i].text != texts[i] for i in range(6))


def test_surrogates_stay_distinct(spark):
    df = spark.createDataFrame([(i, f"a@b{i % 10}.cc x{i}@y.zz") for i in range(300)], "doc_id long, text string")
    got = pii.pii_report(df).collect()
    news = [re.findall(r"\S+@\S+", r.text) for r in got]
    assert len({n[0] for n in news}) == 10 and len({n[1] for n in news}) == 300
