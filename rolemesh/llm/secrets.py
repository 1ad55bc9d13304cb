"""Secrets by form, and by grammars inferred from the secrets found.

Three kinds of secrets are found by pattern; those are labelled credentials. From the
different values of a kind a prefix tree with counts is built, and states whose futures are
statistically compatible (Hoeffding's bound on the shares of every symbol and of stopping)
are merged, first to last, into a probabilistic automaton of the kind. Ordinary long words give
another automaton in the same way. Every other long word of the corpus is then scored by how
much likelier the kind's automaton makes it than the ordinary one, per symbol, and words
that score like the credentials themselves are added.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import slices

# The forms of the three kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs of [0-9a-f]+ with 16 characters or more
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

ORDINARY = "ordinary"
LEAST_CANDIDATE = 12
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST_CANDIDATE},}}")

SAMPLE_PER_KIND = 2_000  # different labelled values that an automaton is fitted on
LEAST_VALUES = 20  # kinds with fewer values get no automaton
CONFIDENCE = 0.05  # of a merge's tests
SMOOTHING = 0.5  # count of a symbol never seen in a state
SYMBOLS = 66 + 1  # of a candidate, and stopping
QUANTILE = 0.05  # share of labelled values that may score below the threshold
MARGIN = 0.5  # least log-likelihood ratio per symbol (natural logarithm)


# --- automata --------------------------------------------------------------------


class Automaton:
    """A probabilistic automaton merged from the prefix tree of some values."""

    def __init__(self, values: Iterable[str], confidence: float = CONFIDENCE):
        # State s: visits, stops, and per symbol (count, next state).
        self.visits, self.stops, self.moves = [0], [0], [{}]
        for value in sorted(set(values)):
            self._add(value)
        self._bound = math.sqrt(0.5 * math.log(2 / confidence))
        self._merge_all()
        self.logs = [self._log_shares(s) for s in range(len(self.visits))]

    def _add(self, value: str) -> None:
        state = 0
        for ch in value:
            self.visits[state] += 1
            count, after = self.moves[state].get(ch, (0, -1))
            if after < 0:
                after = len(self.visits)
                self.visits.append(0)
                self.stops.append(0)
                self.moves.append({})
            self.moves[state][ch] = (count + 1, after)
            state = after
        self.visits[state] += 1
        self.stops[state] += 1

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, kept: int, tree: int) -> bool:
        """Whether a kept state and the root of a subtree agree in all that may follow."""
        todo = [(kept, tree)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            if not n or not m:
                continue
            if self._differ(self.stops[p], n, self.stops[q], m):
                return False
            mine, theirs = self.moves[p], self.moves[q]
            for ch in mine.keys() | theirs.keys():
                a, to = mine.get(ch, (0, -1))
                b, other = theirs.get(ch, (0, -1))
                if self._differ(a, n, b, m):
                    return False
                if to >= 0 and other >= 0:
                    todo.append((to, other))
        return True

    def _fold(self, kept: int, tree: int) -> None:
        """Add the counts of a subtree to the automaton from a kept state on."""
        todo = [(kept, tree)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.stops[p] += self.stops[q]
            for ch, (b, other) in sorted(self.moves[q].items()):
                a, to = self.moves[p].get(ch, (0, -1))
                if to < 0:
                    self.moves[p][ch] = (b, other)  # the branch moves over whole
                else:
                    self.moves[p][ch] = (a + b, to)
                    todo.append((to, other))

    def _merge_all(self) -> None:
        """Kept states grow from the root; each state next to them is merged into the first fit or kept."""
        kept, known = [0], {0}
        front = deque((0, ch) for ch in sorted(self.moves[0]))
        while front:
            source, ch = front.popleft()
            count, state = self.moves[source][ch]
            if state in known:
                continue
            for target in kept:
                if self._compatible(target, state):
                    self.moves[source][ch] = (count, target)
                    before = {(p, c) for p in kept for c in self.moves[p]}
                    self._fold(target, state)
                    front.extend(
                        sorted((p, c) for p in kept for c, (_, to) in self.moves[p].items() if (p, c) not in before and to not in known)
                    )
                    break
            else:
                kept.append(state)
                known.add(state)
                front.extend((state, c) for c in sorted(self.moves[state]))
        number = {s: i for i, s in enumerate(kept)}
        self.visits, self.stops, moves = [self.visits[s] for s in kept], [self.stops[s] for s in kept], self.moves
        self.moves = [{c: (n, number[to]) for c, (n, to) in sorted(moves[s].items())} for s in kept]

    def _log_shares(self, state: int) -> tuple[dict[str, tuple[float, int]], float, float]:
        total = self.visits[state] + SMOOTHING * SYMBOLS
        known = {c: (math.log((n + SMOOTHING) / total), to) for c, (n, to) in self.moves[state].items()}
        return known, math.log(SMOOTHING / total), math.log((self.stops[state] + SMOOTHING) / total)

    def log_likelihood(self, value: str) -> float:
        """Natural logarithm of the share of strings that are ``value``; unknown symbols keep the state."""
        state, total = 0, 0.0
        for ch in value:
            known, other, _ = self.logs[state]
            step, state = known.get(ch, (other, state))
            total += step
        return total + self.logs[state][2]


@dataclass
class Formats:
    """The automata, and for each kind the least likelihood and the least score of a credential."""

    automata: dict[str, Automaton]
    ordinary: Automaton
    floors: dict[str, float]
    thresholds: dict[str, float]

    def likelihood(self, kind: str, value: str) -> float:
        """Log-likelihood per symbol under the kind's automaton."""
        return self.automata[kind].log_likelihood(value) / (len(value) + 1)

    def score(self, kind: str, value: str) -> float:
        """Log-likelihood ratio per symbol of the kind against ordinary words."""
        ratio = self.automata[kind].log_likelihood(value) - self.ordinary.log_likelihood(value)
        return ratio / (len(value) + 1)

    def kind_of(self, value: str) -> tuple[str | None, float]:
        """The likeliest kind whose floor and threshold the value reaches, and its score; None below all."""
        scored = [(self.score(k, value), -i, k) for i, k in enumerate(KINDS) if k in self.automata]
        reached = [x for x in scored if x[0] >= self.thresholds[x[2]] and self.likelihood(x[2], value) >= self.floors[x[2]]]
        top = max(reached or scored, default=(0.0, 0, None))
        return (top[2] if reached else None), top[0]


def _reached_by_most(scores: list[float]) -> float:
    return sorted(scores)[int(QUANTILE * len(scores))]


def fit_formats(values: dict[str, list[str]]) -> Formats:
    """Automata of the labelled values of each kind and of ORDINARY words.

    All but QUANTILE of a kind's values reach its floor, a likelihood, and its threshold, a
    score (MARGIN at least). Both are found on every other value, kept from the fit meanwhile.
    Unlabelled words that reach a floor may be secrets: they are not taken for ordinary ones.
    """
    half, rest = Formats({}, Automaton([]), {}, {}), {}
    for kind in KINDS:
        own = sorted(set(values.get(kind, [])))
        if len(own) >= LEAST_VALUES:
            half.automata[kind], rest[kind] = Automaton(own[::2]), own[1::2]
            half.floors[kind] = _reached_by_most([half.likelihood(kind, v) for v in rest[kind]])
    plain = [w for w in values.get(ORDINARY, []) if all(half.likelihood(k, w) < floor for k, floor in half.floors.items())]
    half.ordinary = Automaton(plain)
    thresholds = {k: max(MARGIN, _reached_by_most([half.score(k, v) for v in own])) for k, own in rest.items()}
    return Formats({k: Automaton(values[k]) for k in rest}, half.ordinary, half.floors, thresholds)


# --- texts -----------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, credential) by start, then kind; code points, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= LEAST_ACCESS:
                out.append((m.start(), 1, m.end(), m[0]))
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """Long runs of credential characters, (start, word), that touch no base span."""
    out, at = [], 0
    for m in _CANDIDATE.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        # The first span that ends behind the word's start begins before all later ones.
        if at == len(base) or base[at][0] >= m.end():
            out.append((m.start(), m[0]))
    return out


SCAN = (
    "doc_id {id}, n_assign long, n_access long, n_hex long, base string, "
    "found array<struct<kind:string,value:string>>, words array<struct<start:int,word:string>>"
)


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans, labelled values and candidates of every row; the texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, base, found, words = [[], [], []], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                for i in range(len(KINDS)):
                    counts[i].append(sum(s[1] == i for s in spans))
                base.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans))
                found.append([{"kind": KINDS[k], "value": v} for _, k, _, v in spans])
                words.append([{"start": a, "word": w} for a, w in candidates(text, spans)])
            kinds = (
                pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])),
                pa.list_(pa.struct([("start", pa.int32()), ("word", pa.string())])),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string())]
                + [pa.array(found, kinds[0]), pa.array(words, kinds[1])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "found", "words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, SCAN.format(id=kind))


def labelled_values(scanned: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> dict[str, list[str]]:
    """Up to ``per_kind`` different values of each kind and of ordinary words, those of smallest hash."""
    found = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.value")
    words = scanned.select(F.explode("words").alias("w")).select(F.lit(ORDINARY).alias("kind"), F.col("w.word").alias("value"))
    different = stored(found.unionByName(words).distinct(), "values")
    out = {}
    for kind in (*KINDS, ORDINARY):
        rows = different.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(per_kind)
        out[kind] = [r.value for r in rows.collect()]
    return out


def find_secrets(docs: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text).

    doc_id, n_assign, n_access, n_hex, base (kind:start:end by start, then kind, comma-joined),
    spans (base, then ``like kind:start:end`` of the words that the automata add, by start) and
    scores (of those words, comma-joined). Null texts count as empty. Repeated rows each have
    their spans; other columns are not read. Without enough labelled values nothing is added.
    """
    scanned = stored(_scan(docs), "secrets")
    formats = fit_formats(labelled_values(scanned, per_kind))
    sent = docs.sparkSession.sparkContext.broadcast(formats)
    out = ["doc_id", "n_assign", "n_access", "n_hex", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str | None, float]] = {}
        for batch in batches:
            spans, scores = [], []
            for base, words in zip(batch.column("base").to_pylist(), batch.column("words").to_pylist()):
                added = []
                for w in words:
                    if len(known) > 1 << 16:
                        known.clear()
                    if w["word"] not in known:
                        known[w["word"]] = sent.value.kind_of(w["word"])
                    kind, score = known[w["word"]]
                    if kind:
                        added.append((f"like {kind}:{w['start']}:{w['start'] + len(w['word'])}", f"{score:.3f}"))
                spans.append(",".join(([base] if base else []) + [s for s, _ in added]))
                scores.append(",".join(s for _, s in added))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in out), pa.array(spans, pa.string()), pa.array(scores, pa.string())],
                names=[*out, "spans", "scores"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scanned.select(*out, "words").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string, scores string"
    )
