"""Loss spans under templates that rewrite history, and URL rules against a miner that tries all subsets."""

import itertools
import math
import re
import time

import numpy as np
import pytest

from takeup.llm import chat, url_rules

TALK = [("system", "be brief"), ("user", "hello there"), ("assistant", "<think>a b</think>yes </e>"), ("user", "yes"), ("assistant", "second"),
        ("user", "and?"), ("assistant", ""), ("user", "more"), ("assistant", "yes")]


def forgets(turns, prompt=False):
    """Earlier assistant turns lose their text."""
    return "".join(f"<{r}>{t if r != 'assistant' or i == len(turns) - 1 else ''}</e>" for i, (r, t) in enumerate(turns)) + "<assistant>" * prompt


def drops_thoughts(turns, prompt=False):
    """Earlier assistant turns keep what follows their thoughts."""
    def cut(i, r, t):
        return re.sub("<think>.*?</think>", "", t) if r == "assistant" and i < len(turns) - 1 else t
    return "".join(f"<{r}>{cut(i, r, t)}</e>" for i, (r, t) in enumerate(turns)) + "<assistant>" * prompt


def counts_back(turns, prompt=False):
    """Every turn is numbered from the end, so all of history moves."""
    return "".join(f"[{len(turns) - i}]<{r}>{t}</e>" for i, (r, t) in enumerate(turns)) + "[0]<assistant>" * prompt


def shouts(turns, prompt=False):
    """Changes every text, and all of history with every turn."""
    return "".join(f"<{r}>{t.upper()}.{len(turns)}</e>" for r, t in turns)


@pytest.mark.parametrize("template,learnt,lost", [
    (forgets, ["yes"], 2), (drops_thoughts, ["yes </e>", "second", "", "yes"], 0),
    (counts_back, ["<think>a b</think>yes </e>", "second", "", "yes"], 0), (chat.instruct_template, None, 0)])
def test_the_mask_holds_assistant_text_of_the_final_output(template, learnt, lost):
    for n in range(len(TALK) + 1):
        made = chat.render(TALK[:n], template)
        own = [t for r, t in TALK[:n] if r == "assistant"]
        assert made["formatted"] == template(TALK[:n], False)
        assert len(made["loss"]) + made["lost_loss"] == len(own)
        for span in made["loss"]:
            said = chat.unescape(made["formatted"][span["start"]:span["stop"]]) if template is chat.instruct_template else made["formatted"][span["start"]:span["stop"]]
            assert any(said == t or said == re.sub("<think>.*?</think>", "", t) for t in own)
        starts = [s["start"] for s in made["loss"]]
        assert starts == sorted(starts)
    if learnt is not None:
        text = made["formatted"]
        assert [text[s["start"]:s["stop"]] for s in made["loss"]][-len(learnt):] == learnt and made["rewrites"] > 0
    if template is forgets:  # emptied turns are found where they are empty, or counted
        assert made["lost_loss"] >= lost


def test_texts_are_found_as_the_template_writes_them_or_lost():
    made = chat.render(TALK, shouts)
    assert [made["formatted"][s["start"]:s["stop"]] for s in made["loss"]] == [t.upper() for r, t in TALK if r == "assistant"]

    def counts(turns, prompt=False):  # nothing of a text is left
        return f"{len(turns)}:" + "".join(f"<{r}{len(t)}>" for r, t in turns)

    made = chat.render(TALK, counts)
    assert made["loss"] == [] and made["lost_loss"] == 4


def test_marks_inside_texts_are_no_places():
    talk = [("user", "a"), ("assistant", "x"), ("user", "b")]
    made = chat.render(talk, counts_back)
    assert made["loss"] == [] and made["lost_loss"] == 1 and made["turns"][1]["start"] is None


def wilson(k, n, z=2.33):
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def brute_rules(rows, min_support=0.004, min_confidence=0.6, min_lower=0.5):
    """Minimal rules among all subsets of all URLs' tokens."""
    subsets = {frozenset(c) for tokens, bad in rows if bad for k in range(1, len(tokens) + 1) for c in itertools.combinations(tokens, k)}
    found = []
    for s in subsets:
        n = sum(s <= set(t) for t, _ in rows)
        k = sum(s <= set(t) and bad for t, bad in rows)
        if k / len(rows) >= min_support and k / n >= min_confidence and wilson(k, n) >= min_lower:
            found.append(s)
    return [s for s in found if not any(o < s for o in found)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_rules_block_what_all_subsets_block(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(160):
        tokens = [t for t in "abcdefg" if rng.random() < 0.45]
        bad = rng.random() < (0.95 if {"a", "b"} <= set(tokens) or "c" in tokens and "d" not in tokens else 0.1)
        rows.append((tokens, bool(bad)))
    df = spark.createDataFrame([(t, b) for t, b in rows], "tokens array<string>, bad boolean").repartition(3)
    got = [frozenset(r.rule) for r in url_rules.mine(df).collect()]
    want = brute_rules([r for r in rows if r[0]])
    assert sorted(map(sorted, got)) == sorted(map(sorted, want)) and want


def test_every_token_of_a_long_url_takes_part(spark):
    """Sixteen common tokens with more bad URLs than the pair that is bad together; by brute force over pairs of tokens."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        pair = [t for t in ("u", "v") if rng.random() < 0.3]
        bad = rng.random() < (0.97 if len(pair) == 2 else 0.0 if pair else 0.35)
        if len(pair) == 2:
            tokens = [f"c{k:02}" for k in range(16)] + pair
        else:
            tokens = [f"c{k:02}" for k in range(16) if rng.random() < (0.55 if bad else 0.3)] + pair
        rows.append((tokens, bool(bad)))
    rows = [(t, b) for t, b in rows if t]
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean").repartition(3)
    got = {tuple(r.rule): (r.confidence, r.support) for r in url_rules.mine(df, min_support=0.05).collect()}
    names, short = sorted({t for r, _ in rows for t in r}), []
    for k in (1, 2):
        for s in itertools.combinations(names, k):
            n, hits = sum(set(s) <= set(t) for t, _ in rows), sum(set(s) <= set(t) and b for t, b in rows)
            if n and hits / len(rows) >= 0.05 and hits / n >= 0.6 and wilson(hits, n) >= 0.5 and not any(set(o) < set(s) for o in short):
                short.append(s)
                assert got[s] == (hits / n, hits / len(rows))
    assert ("u", "v") in short and {r for r in got if len(r) < 3} == set(short)


@pytest.mark.parametrize("seed", [0, 1])
def test_rules_of_nearly_equal_urls(spark, seed):
    """Keys that each miss in a few of the URLs, more than any cut of a URL's tokens would keep; all subsets by brute force."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(150):
        tokens = [f"k{k:02}" for k in range(14) if rng.random() < 0.9] if i < 40 else []
        tokens += ["s:http" if rng.random() < 0.5 else "s:https"] + (["x"] if rng.random() < 0.4 else [])
        rows.append((tokens, bool(rng.random() < (0.35 + 0.55 * ("x" in tokens) if i < 40 else 0.1))))
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean").repartition(3)
    got = [frozenset(r.rule) for r in url_rules.mine(df, min_support=0.06).collect()]
    bits = {t: sum(1 << i for i, r in enumerate(rows) if t in r[0]) for t in {t for r, _ in rows for t in r}}
    bad = sum(1 << i for i, r in enumerate(rows) if r[1])
    shown = {}
    for t in sorted(bits):  # one name per set of rows, as in mine
        shown.setdefault(bits[t], t)
    want = []
    for k in range(1, 18):
        for s in itertools.combinations(sorted(shown.values()), k):
            held = (1 << len(rows)) - 1
            for t in s:
                held &= bits[t]
            n, hits = held.bit_count(), (held & bad).bit_count()
            if n and hits / len(rows) >= 0.06 and hits / n >= 0.6 and wilson(hits, n) >= 0.5 and not any(o < set(s) for o in want):
                want.append(frozenset(s))
    assert sorted(map(sorted, got)) == sorted(map(sorted, want)) and max(map(len, want)) > 1


def test_many_equal_query_keys_end_quickly(spark):
    """Sixty of 2,000 URLs with the same 25 query keys, half of them bad, so that no key is a rule by itself."""
    keys = "&".join(f"k{i}=1" for i in range(25))
    pages = [(i, f"http://h{i % 7}.org/{'x' if i % 2 else 'y'}/?{keys}" if i < 60 else f"http://h{i % 7}.org/{'x' if i % 5 else 'z'}/", "") for i in range(2000)]
    labels = [(i, int(not (i < 60 and i % 2)), 0) for i in range(2000)]
    begin = time.perf_counter()
    got = url_rules.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"),
                               spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert time.perf_counter() - begin < 60
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i in range(60) if i % 2}


def test_one_frequent_url_null_urls_and_no_labels(spark):
    pages = [(i, None if i % 3 == 0 else "http://same.org/bad", "x") for i in range(300)]
    labels = [(i, 0, 0) for i in range(1, 300, 3)]
    frame = spark.createDataFrame(pages, "page_id long, url string, token string")
    got = url_rules.judge_urls(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.page_id % 3 == 0, r.verdict) for r in got} == {(True, "allow"), (False, "block")} and len(got) == 300
    none = url_rules.judge_urls(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("verdict = 'block'").count() == 0
