"""Secret scan: fixed patterns, and formats inferred from the credentials they find.

1. One pass over the texts finds the base spans (assignments, access keys, long hexadecimal
   runs) and every token of their alphabet and least length that is not inside one of them, with
   its parts between dots.
2. The values of the base spans are the labelled credentials. Per kind, all distinct values form
   a prefix tree over character classes. States whose endings and transitions agree within
   Hoeffding's bound are merged (red-blue order), which leaves a small probabilistic automaton per
   format. The tree stays in Spark: in every round all values, whole, run through the states known
   so far, the prefixes of what is left of them are counted and compared, and one more state is
   known. The last visits of all values are the counts, their scores the threshold. Kinds with few
   values share one automaton.
3. All candidates are scored: the mean log2 likelihood of their characters under an automaton
   must reach what 95 % of its training values reach, and beat a model of uniform
   characters as well as one of the character pairs of all the corpus's own candidates, which is
   what ordinary words follow. Those that do are spans of kind ``inferred``.

Null and empty texts have no spans. Very long texts are scanned whole. Repeated rows count like
any other; without any credential there is no automaton and only base spans remain. Other
columns travel in one struct and may have any name.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain, pairwise
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from takeup.llm.common import bounded_batches, stage
from takeup.operators.ordering import cumulate, distinct_values

# fixed values: the base patterns and their least lengths
KINDS = ("assign", "access", "hex")
BASE = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
CANDIDATE = r"[A-Za-z0-9+/_.=-]{12,}"
LEAST = 12
INFERRED = "inferred"
SPAN = "array<struct<kind string, start int, stop int, value string>>"

#: characters per class; other characters are classes of their own
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS_OF = {c: (name, len(members)) for name, members in CLASSES.items() for c in members}
_ALPHABET = len(CLASSES) + 5

#: what follows the last character of a value; the symbols of a state's counts, in their order
END = ""
SYMBOLS = (*CLASSES, *"+/_.=-", END)
_PLACE = {s: i for i, s in enumerate(SYMBOLS)}

#: rolling hash of the symbols on the way to a prefix
_MODULUS, _BASE = (1 << 61) - 1, 0x1B873593A7C15F39 % ((1 << 61) - 1)


def scan(text: str | None) -> tuple[list[tuple], list[tuple]]:
    """Base spans by start, then kind; candidate tokens outside of them."""
    if not text:
        return [], []
    base = []
    for kind, (pattern, group, least) in BASE.items():
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                base.append((kind, m.start(), m.end(), m[group]))
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    taken, at, others, stop = sorted((s[1], s[2]) for s in base), 0, [], 0
    for m in re.finditer(CANDIDATE, text):
        while at < len(taken) and taken[at][0] <= m.start():
            stop = max(stop, taken[at][1])
            at += 1
        for start, end in parts(m[0], m.start()):
            inside = end <= stop or any(a <= start and end <= b for a, b in _from(taken, at, end))
            if not inside:
                others.append((INFERRED, start, end, text[start:end]))
    return base, others


def _from(taken: list[tuple[int, int]], at: int, end: int):
    while at < len(taken) and taken[at][0] < end:
        yield taken[at]
        at += 1


def parts(token: str, start: int) -> list[tuple[int, int]]:
    """A token without dots at its ends, then what lies between its dots, where long enough."""
    first = len(token) - len(token.lstrip("."))
    found = [(start + first, start + len(token.rstrip(".")))]
    if "." in token[first:len(token.rstrip("."))]:
        found += [(start + m.start(), start + m.end()) for m in re.finditer(r"[^.]+", token)]
    return [(a, b) for a, b in found if b - a >= LEAST]


# -- grammar inference ------------------------------------------------------------

def classes(value: str) -> list[tuple[str, int]]:
    return [_CLASS_OF.get(c, (c, 1)) for c in value]


class Automaton:
    """Probabilistic automaton learned from strings by state merging."""

    def __init__(self, values: list[str] = (), alpha: float = 0.05, quantile: float = 0.05):
        self.alpha = alpha
        self.step: list[dict[str, int]] = [{}]
        self.seen, self.ended, self.passed = [0], [0], [{}]
        self.above: list[tuple[int, str] | None] = [None]
        for value in values:
            self._add([name for name, _ in classes(value)])
        self._merge_all()
        scores = sorted(self.score(v) for v in values)
        self.least = scores[int(quantile * len(scores))] if scores else math.inf

    def _new(self, state: int, symbol: str) -> int:
        self.step[state][symbol] = len(self.step)
        self.step.append({}), self.seen.append(0), self.ended.append(0), self.passed.append({})
        self.above.append((state, symbol))
        return self.step[state][symbol]

    def _add(self, symbols: list[str]) -> None:
        state = 0
        self.seen[0] += 1
        for s in symbols:
            self.passed[state][s] = self.passed[state].get(s, 0) + 1
            if s not in self.step[state]:
                self._new(state, s)
            state = self.step[state][s]
            self.seen[state] += 1
        self.ended[state] += 1

    def visits(self, word: str) -> list[tuple[int, str]]:
        """The states that a string of classes passes, each with the symbol read there, ``END`` in the last. The way ends
        at a transition that is not known yet."""
        state, found = 0, []
        for symbol in word:
            found.append((state, symbol))
            if symbol not in self.step[state]:
                return found
            state = self.step[state][symbol]
        return found + [(state, END)]

    def open_transitions(self) -> list[tuple[int, str]]:
        """Counted transitions that lead to no known state."""
        return [(q, s) for q, passed in enumerate(self.passed) for s in sorted(passed) if s not in self.step[q]]

    def settle(self, differing: set[tuple[int, str, int]]) -> None:
        """Lead every open transition to the first state that it does not differ from; of those that differ from all
        states, the first becomes a state and the others wait."""
        known, grown = len(self.step), False
        for q, s in self.open_transitions():
            same = next((r for r in range(known) if (q, s, r) not in differing), None)
            if same is not None:
                self.step[q][s] = same
            elif not grown:
                grown = True
                self._new(q, s)

    def count(self, visits: dict[tuple[int, str], int]) -> None:
        """Take the summed visits of all values as the counts of the states."""
        self.seen, self.ended, self.passed = [0] * len(self.step), [0] * len(self.step), [{} for _ in self.step]
        for (state, symbol), n in visits.items():
            self.seen[state] += n
            if symbol == END:
                self.ended[state] = n
            else:
                self.passed[state][symbol] = n

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(x / n - y / m) > bound

    def _compatible(self, a: int, b: int) -> bool:
        todo, done = [(a, b)], set()
        while todo:
            a, b = pair = todo.pop()
            if pair in done:
                continue
            done.add(pair)
            n, m = self.seen[a], self.seen[b]
            if not n or not m:
                continue
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for s in {*self.passed[a], *self.passed[b]}:
                if self._differ(self.passed[a].get(s, 0), n, self.passed[b].get(s, 0), m):
                    return False
                if s in self.step[a] and s in self.step[b]:
                    todo.append((self.step[a][s], self.step[b][s]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ended[a] += self.ended[b]
            for s, n in self.passed[b].items():
                self.passed[a][s] = self.passed[a].get(s, 0) + n
            for s, child in self.step[b].items():
                if s in self.step[a]:
                    todo.append((self.step[a][s], child))
                else:
                    self.step[a][s], self.above[child] = child, (a, s)

    def _merge_all(self) -> None:
        red, known = [0], {0}
        while True:
            blue = sorted({c for r in red for c in self.step[r].values() if c not in known})
            if not blue:
                return
            for r in red:
                if self._compatible(r, blue[0]):
                    parent, symbol = self.above[blue[0]]
                    self.step[parent][symbol] = r
                    self._fold(r, blue[0])
                    break
            else:
                red.append(blue[0])
                known.add(blue[0])

    def score(self, value: str, prior: float = 0.02) -> float:
        """Mean log2 likelihood per character, the ending included."""
        return self._likelihood(classes(value), prior)

    def score_word(self, word: str, prior: float = 0.02) -> float:
        """The score of the values with these classes."""
        return self._likelihood([(s, len(CLASSES.get(s, s))) for s in word], prior)

    def _likelihood(self, symbols: list[tuple[str, int]], prior: float) -> float:
        state, total = 0, 0.0
        for name, size in symbols:
            weight = self.seen[state] + prior * _ALPHABET
            total += math.log2((self.passed[state].get(name, 0) + prior) / weight / size)
            state = self.step[state].get(name, state)
        total += math.log2((self.ended[state] + prior) / (self.seen[state] + prior * _ALPHABET))
        return total / max(1, len(symbols))

    def accepts(self, value: str, floor: float | None = None) -> bool:
        return self.score(value) >= max(self.least, uniform(value) if floor is None else floor)


def uniform(value: str) -> float:
    """Score of a value under uniform characters, the ending included as in the other scores."""
    return -math.log2(66) * (len(value) + 1) / max(1, len(value))


class Background:
    """Pairs of neighbouring characters in tokens that are not known to be credentials."""

    def __init__(self, values: list[str]):
        self.values, self.pairs, self.seen = set(values), Counter(), Counter()
        for value in self.values:
            self.pairs.update(self._pairs(value))
            self.seen.update("^" + value)

    @classmethod
    def of_pairs(cls, pairs: dict[tuple[str, str], int]) -> "Background":
        """From the pairs of all values that will be scored, each distinct one counted once."""
        model = cls([])
        model.values = None
        for (a, b), n in pairs.items():
            model.pairs[a, b] = n
            model.seen[a] += n
        return model

    @staticmethod
    def _pairs(value: str) -> list[tuple[str, str]]:
        return list(zip("^" + value, value + "$"))

    def score(self, value: str) -> float:
        """Mean log2 likelihood per character, the ending included, without what the value itself added; at
        least that of uniform characters."""
        pairs, total = self._pairs(value), 0.0
        counted = self.values is None or value in self.values
        own, left = (Counter(pairs), Counter("^" + value)) if counted else ({}, {})
        for a, b in pairs:
            total += math.log2((self.pairs[a, b] - own.get((a, b), 0) + 1) / (self.seen[a] - left.get(a, 0) + 66))
        return max(total / max(1, len(value)), uniform(value))


# -- Spark ------------------------------------------------------------------------

def _lists(counts, spans: pa.StructArray) -> pa.ListArray:
    """The first ``counts[0]`` spans in one list, the next ``counts[1]`` in the next."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32()), spans)


class _Spans:
    """Spans of many texts, column by column: no tuple or dict of a span outlives its text."""

    def __init__(self):
        self.counts, self.kinds, self.starts, self.stops, self.values = array("i"), [], array("i"), array("i"), []

    def add(self, spans: list[tuple]) -> None:
        self.counts.append(len(spans))
        for kind, start, stop, value in spans:
            self.kinds.append(kind)
            self.starts.append(start)
            self.stops.append(stop)
            self.values.append(value)

    def arrow(self) -> pa.ListArray:
        whole = [pa.array(np.frombuffer(x, np.int32)) if len(x) else pa.array([], pa.int32()) for x in (self.starts, self.stops)]
        return _lists(self.counts, pa.StructArray.from_arrays(
            [pa.array(self.kinds, pa.string()), *whole, pa.array(self.values, pa.string())], ["kind", "start", "stop", "value"]))


def find_spans(texts: pa.Array) -> pa.Array:
    base, others = _Spans(), _Spans()
    for text in texts:
        for spans, found in zip((base, others), scan(text.as_py())):
            spans.add(found)
    return pa.StructArray.from_arrays([base.arrow(), others.arrow()], ["base", "others"])


def train(found: DataFrame, least: int = 8, quantile: float = 0.05, alpha: float = 0.05) -> dict[str, Automaton]:
    """An automaton per kind with at least ``least`` distinct labelled values; the values of all smaller kinds
    share one, with those of the other kinds if they are fewer than ``least`` together.

    All values take part with all their characters. A round adds at most one state to every automaton and costs two jobs
    over the distinct strings of classes. The automata and which of their open transitions differ from which states come
    to the driver, the prefix tree does not.
    """
    values = stage(_distinct(found, "base"), "secret_values")
    sizes = {r["kind"]: r["n"] for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    small = [k for k in KINDS if 0 < sizes.get(k, 0) < least]
    few = small and sum(sizes[k] for k in small) < least
    fed = {k: (["pooled"] if k in small else [k]) + (["pooled"] if few and k not in small else []) for k in sizes}
    models = {name: Automaton(alpha=alpha) for names in fed.values() for name in names}
    if not models:
        return {}
    words = stage(_words(values, fed), "secret_words")
    growing = set(models)
    while growing:
        for name, visits in _visits(words.where(F.col("model").isin(*growing)), models).items():
            models[name].count(visits)
        growing = {name for name in growing if models[name].open_transitions()}
        differing = _differing(words, {name: models[name] for name in growing}, alpha)
        for name in growing:
            models[name].settle(differing.get(name, set()))
    for name, score in _lowest(words, models, sum(sizes[k] * len(names) for k, names in fed.items()), quantile).items():
        models[name].least = score
    return models


def _words(values: DataFrame, fed: dict[str, list[str]]) -> DataFrame:
    """Per automaton the distinct strings of classes with the number ``n`` of their values."""
    model = F.lit(None).cast("array<string>")
    for kind, names in fed.items():
        model = F.when(F.col("kind") == kind, F.array(*[F.lit(n) for n in names])).otherwise(model)
    word = F.translate("value", "".join(_CLASS_OF), "".join(name for name, _ in _CLASS_OF.values()))
    return values.select(F.explode(model).alias("model"), word.alias("word")).groupBy("model", "word").agg(F.count("*").alias("n"))


def _rows(batch: pa.RecordBatch):
    return zip(*[batch.column(c).to_pylist() for c in ("model", "word", "n")])


def _visits(words: DataFrame, models: dict[str, Automaton]) -> dict[str, dict[tuple[int, str], int]]:
    """Per automaton how often all its values pass each state with each symbol."""
    def counted(batches):
        total = Counter()
        for batch in batches:
            for name, word, n in _rows(batch):
                for visit, times in Counter(models[name].visits(word)).items():
                    total[name, *visit] += n * times
        if total:
            rows = [(*key, n) for key, n in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["model", "state", "symbol", "n"])

    rows = words.mapInArrow(counted, "model string, state long, symbol string, n long")
    found = {}
    for r in rows.groupBy("model", "state", "symbol").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["model"], {})[r["state"], r["symbol"]] = r["n"]
    return found


def _left(word: str, model: Automaton) -> tuple[int, str] | None:
    """The number of the open transition that a word takes and what follows it."""
    state, at = 0, 0
    while at < len(word) and word[at] in model.step[state]:
        state, at = model.step[state][word[at]], at + 1
    # a single value differs from nothing: the bound is above 1
    if at == len(word) or model.passed[state][word[at]] < 2:
        return None
    return state * len(SYMBOLS) + _PLACE[word[at]], word[at + 1:]


class _Way:
    """The prefixes of one string behind an open transition: of each the hash, the counts of the symbols that follow it and
    where the known states lead on the same way."""

    def __init__(self, model: Automaton):
        self.model, self.places = model, array("b")
        self.sums, self.powers, self.counts = array("q", [0]), array("q", [1]), array("q", bytes(8 * len(SYMBOLS)))
        self.states = [{r: [r] for r in range(len(model.step))}]
        # open transitions that known states took, with the prefix before them; how many there are at each prefix
        self.entered, self.marks = [], array("q", [0])

    def add(self, symbol: str, n: int) -> None:
        self.counts[_PLACE[symbol] - len(SYMBOLS)] += n

    def push(self, symbol: str) -> None:
        model, place, states, moved = self.model, _PLACE[symbol], self.states[-1], {}
        self.places.append(place)
        for r, starts in states.items():
            if symbol in model.step[r]:
                moved[model.step[r][symbol]] = moved.get(model.step[r][symbol], []) + starts
            elif model.passed[r].get(symbol, 0) > 1:
                self.entered.append((r * len(SYMBOLS) + place, len(self.places), starts))
        self.states.append(states if moved == states else moved)
        self.marks.append(len(self.entered))
        self.sums.append((self.sums[-1] * _BASE + place + 1) % _MODULUS)
        if len(self.powers) < len(self.sums):
            self.powers.append(self.powers[-1] * _BASE % _MODULUS)
        self.counts.frombytes(bytes(8 * len(SYMBOLS)))

    def pop(self, kept: bool) -> tuple[int, list[int], list[tuple]] | None:
        """End the longest prefix and add its values to the one before. If they are several or it is ``kept``: its hash, its
        counts and what the known states reach there, states (``blue`` is null) or prefixes."""
        depth, counts = len(self.places), self.counts[-len(SYMBOLS):].tolist()
        del self.counts[-len(SYMBOLS):]
        node, states, found = self.sums.pop(), self.states.pop(), None
        if kept or sum(counts) > 1:
            near = [(None, r, starts) for r, starts in states.items()]
            near += [(b, (node - self.sums[j] * self.powers[depth - j]) % _MODULUS if j < depth else 0, starts)
                     for b, j, starts in self.entered]
            found = node, counts, near
        self.marks.pop()
        if depth:
            del self.entered[self.marks[-1]:]
            self.counts[self.places.pop() - len(SYMBOLS)] += sum(counts)
        return found


def _prefixes(rows, models: dict[str, Automaton]):
    """Prefixes of the sorted ``(model, blue, rest, n)``, each once: model, blue, hash, counts, near. Those of a single value
    differ from nothing and are left out, but for those of the first and the last string, with which the neighbouring tasks
    may go on. Of a single value no more is walked than it shares with the strings beside it."""
    group, way, same, edge = None, None, 0, -1
    for (name, blue, rest, n), after in pairwise(chain(rows, [None])):
        first, depth = group is None, len(rest)
        if (name, blue) != group:  # a new way; ``edge``: so many of its symbols begin the first string too
            group, way, same, edge = (name, blue), _Way(models[name]), 0, len(rest) if first else -1
        ahead = len(commonprefix((rest, after[2]))) if after and after[:2] == group else -1
        if n == 1 and not first and after:
            depth = max(same, ahead)
        for symbol in rest[same:depth]:
            way.push(symbol)
        way.add(rest[depth:depth + 1], n)
        while len(way.sums) > ahead + 1:
            if found := way.pop(not after or len(way.places) <= edge):
                yield *group, *found
        same, edge = ahead, min(edge, ahead)


def _differing(words: DataFrame, models: dict[str, Automaton], alpha: float) -> dict[str, set[tuple[int, str, int]]]:
    """Per automaton its open transitions with the states that they may not lead to: somewhere on the same way
    endings or transitions differ by more than Hoeffding's bound."""
    models = {name: m for name, m in models.items() if any(m.passed[q][s] > 1 for q, s in m.open_transitions())}
    if not models:
        return {}
    near = "array<struct<blue int, node long, starts array<int>>>"
    kinds = pa.list_(pa.struct([("blue", pa.int32()), ("node", pa.int64()), ("starts", pa.list_(pa.int32()))]))
    places = [f"n{i}" for i in range(len(SYMBOLS))]

    def left(batches):
        for batch in batches:
            total = Counter()  # many values may leave a state in the same way
            for name, word, n in _rows(batch):
                if way := _left(word, models[name]):
                    total[name, *way] += n
            columns = list(zip(*((*key, n) for key, n in total.items()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
                columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["model", "blue", "rest", "n"])

    def table(rows):
        names, blues, nodes, counts, reached = zip(*rows)
        reached = pa.array([[dict(zip(("blue", "node", "starts"), p)) for p in ps] for ps in reached], kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(blues, pa.int32()), pa.array(nodes, pa.int64()),
             *[pa.array(c, pa.int64()) for c in zip(*counts)], reached], ["model", "blue", "node", *places, "near"])

    def walked(batches):
        rows, size = [], 0
        for row in _prefixes((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])), models):
            rows.append(row)
            size += 1 + len(row[-1])
            if size >= 1 << 15:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)

    rests = words.where(F.col("model").isin(*models)).mapInArrow(left, "model string, blue int, rest string, n long")
    rows = rests.orderBy("model", "blue", "rest").mapInArrow(
        walked, f"model string, blue int, node long, {', '.join(f'{c} long' for c in places)}, near {near}")
    nodes = rows.groupBy("model", "blue", "node").agg(
        F.array(*[F.sum(c) for c in places]).alias("counts"), F.first("near").alias("near"))
    nodes = nodes.withColumn("all_n", F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).where("all_n > 1")
    nodes = stage(nodes, "secret_prefixes")  # three branches read them
    known = words.sparkSession.createDataFrame(
        [(name, state, [m.ended[state] if s == END else m.passed[state].get(s, 0) for s in SYMBOLS], m.seen[state])
         for name, m in models.items() for state in range(len(m.step))],
        "model string, node long, other_counts array<long>, other_n long")
    others = nodes.select("model", F.col("blue").alias("to_blue"), F.col("node").alias("to_node"),
                          F.col("counts").alias("other_counts"), F.col("all_n").alias("other_n"))
    pairs = nodes.select("model", "blue", "counts", "all_n", F.explode("near").alias("to")).select(
        "model", "blue", "counts", "all_n", F.col("to.blue").alias("to_blue"), F.col("to.node").alias("to_node"), "to.starts")
    states = pairs.where("to_blue is null").join(F.broadcast(known.withColumnRenamed("node", "to_node")), ["model", "to_node"])
    prefixes = pairs.where("to_blue is not null").join(others, ["model", "to_blue", "to_node"])
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    differ = F.expr(f"exists(zip_with(counts, other_counts, (x, y) -> abs(x / all_n - y / other_n) > "
                    f"{bound!r}D * (1 / sqrt(all_n) + 1 / sqrt(other_n))), d -> d)")
    columns = ["model", "blue", "starts"]
    found = states.where("other_n > 0").where(differ).select(*columns).unionByName(prefixes.where(differ).select(*columns))
    out = {}
    for r in found.select("model", "blue", F.explode("starts").alias("state")).distinct().collect():
        out.setdefault(r["model"], set()).add((r["blue"] // len(SYMBOLS), SYMBOLS[r["blue"] % len(SYMBOLS)], r["state"]))
    return out


def _lowest(words: DataFrame, models: dict[str, Automaton], rows: int, quantile: float) -> dict[str, float]:
    """Per automaton the score that all but ``quantile`` of its values reach, from all of them."""
    def scored(batches):
        for batch in batches:
            found = [(name, models[name].score_word(word), n) for name, word, n in _rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(
                (pa.string(), pa.float64(), pa.int64()))], ["model", "score", "n"])

    scores = words.mapInArrow(scored, "model string, score double, n long")
    counts = distinct_values(scores, ["model"], "score", {"n": F.sum("n")})
    place = F.floor(F.col("all_n") * F.lit(quantile))
    at = (F.col("below_n") <= place) & (place < F.col("below_n") + F.col("n"))
    return {r["model"]: r["score"] for r in cumulate(counts, ["model"], "score", ["n"], rows).where(at).collect()}


def background(found: DataFrame) -> Background:
    """From the character pairs of all distinct candidates, summed in the tasks; at most one row per pair of
    characters comes to the driver."""
    def counted(batches):
        total = np.zeros(1 << 14, np.int64)
        for batch in batches:
            if batch.num_rows:
                text = np.frombuffer(("^" + "$^".join(batch.column(0).to_pylist()) + "$").encode(), np.uint8).astype(np.int64)
                total += np.bincount((text[:-1] << 7) + text[1:], minlength=1 << 14)
        total[(ord("$") << 7) + ord("^")] = 0  # between two values
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[codes])], ["pair", "n"])

    pairs = _distinct(found, "others").select("value").mapInArrow(counted, "pair long, n long")
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Background.of_pairs({(chr(r["pair"] >> 7), chr(r["pair"] & 127)): r["n"] for r in rows})


def _distinct(found: DataFrame, spans: str) -> DataFrame:
    return found.select(F.explode(spans).alias("s")).select("s.kind", "s.value").distinct()


def scorer(models: dict[str, Automaton], ordinary: Background):
    @F.arrow_udf(SPAN)
    def inferred(rows: pa.Array) -> pa.Array:
        @lru_cache(1 << 16)
        def accepted(value: str) -> bool:
            floor = ordinary.score(value)
            return any(m.accepts(value, floor) for m in models.values())

        spans = rows.flatten()
        values = spans.field("value").dictionary_encode()
        good = pa.array([accepted(v.as_py()) for v in values.dictionary], pa.bool_()).take(values.indices)
        row = pc.list_parent_indices(rows).filter(good).to_numpy()
        return _lists(np.bincount(row, minlength=len(rows)), spans.filter(good))

    return inferred


def scanned(docs: DataFrame, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns), ``base`` and ``inferred`` spans of every document."""
    bounded_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    scanner = F.arrow_udf(find_spans, f"struct<base {SPAN}, others {SPAN}>")
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), scanner(F.col(text_column)).alias("found"))
    rows = stage(rows.select("row", "found.base", "found.others"), "secret_spans")
    models = train(rows)
    ordinary = background(rows) if models else Background([])
    return rows.select("row", "base", scorer(models, ordinary)("others").alias("inferred"))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


def secret_report(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Counts and digests of the spans of every document."""
    rows = scanned(docs, carry=[id_column], **options)
    order = "array_position(array('assign', 'access', 'hex', 'inferred'), s.kind)"
    rows = rows.withColumn("spans", F.expr(
        f"transform(array_sort(transform(concat(base, inferred), s -> struct(s.start as start, {order} as place, s.stop as stop,"
        " s.kind as kind))), s -> struct(s.kind as kind, s.start as start, s.stop as stop))"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return rows.select(F.col(f"row.{id_column}").alias(id_column), *counts,
                       F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))


def _redact(text: str | None, spans: list[dict], mark: str) -> str | None:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], mark]
        at = max(at, s["stop"])
    return text if not out else "".join(out) + text[at:]


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span replaced; all other columns stay."""
    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_redact(t.as_py(), s.as_py(), mark) for t, s in zip(texts, spans)], type=pa.string())

    rows = scanned(docs, text_column, **options).withColumn("spans", F.concat("base", "inferred"))
    text = F.col(f"row.{text_column}")
    # only documents with spans go through Python
    clean, hit = rows.where("size(spans) = 0"), rows.where("size(spans) > 0").withColumn("clean", cleaned(text, F.col("spans")))
    rows = clean.withColumn("clean", text).unionByName(hit)
    return rows.select(*[F.col("clean").alias(c) if c == text_column else F.col(f"row.{c}").alias(c) for c in docs.columns])
