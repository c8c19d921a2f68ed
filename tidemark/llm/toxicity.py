"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses at sentence marks and line ends (commas, colons and quotation marks stay inside: "she said: ..." is one clause); a clause becomes a string of symbols (insult, threat,
target, negation, report, boost, other). Small weighted transducers each rewrite
one aspect of the match: what attacks (insults, or threat verbs before a target),
whom (a target near the attack adds weight), whether it is negated (scope of a few words after the
negation takes weight away) and whether it is someone else's words (a report takes
weight away to the end of the clause). Their product is compiled into one automaton
whose paths weigh each matched clause; words outside a match weigh nothing.

The closed classes and a small seed of insults are fixed. Further insult terminals, whole words or stems,
are learned from at most ``fit_rows`` labelled documents: those whose document counts
under the two labels could not be chance, after near copies in the sample have been put aside. A logistic curve
fitted to the same rows turns the weight of all matches into the score.

Defined cases: null, empty and other texts without a match get the score of no match; very long texts are read whole; repeated rows score alike;
ties in the choice of terminals go to the first by name; an empty table gives no rows; without labels
of both classes the seed grammar keeps a fixed curve; other columns are ignored. Labels, language, source and id
are no inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, small_batches, texts
from tidemark.llm.labelled import labelled_sample

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BOOST = range(7)
#: Closed classes in four languages, and seed terminals.
CLOSED = {
    TARGET: "you your yours yourself u he him she her they them these those people du dich dir ihr euch sie tu toi vous ils elles te usted ustedes ellos ellas",
    NEGATION: "not no never nobody isn't aren't wasn't don't doesn't didn't won't nicht kein keine niemals nie ne pas jamais nunca jamás",
    REPORT: "said says wrote claimed quoted called reported alleged according sagte schrieb behauptete zitierte dit écrit selon dijo escribió según",
    BOOST: "so such very really absolutely total complete utter fucking sehr total völlig très vraiment muy totalmente",
    THREAT: "kill hurt destroy burn shoot stab hang beat murder attack töten umbringen tuer frapper matar golpear",
}
SEED_INSULTS = "idiot moron scum worthless pathetic clown loser stupid trash disgusting imbecile trottel abschaum dummkopf versager widerling crétin ordure imbécile minable salaud idiota imbécil basura escoria patético"
#: Weights of the component transducers (log scale). Alone an insult stays below the threshold of the unfitted curve, against a target it passes.
WEIGHTS = {"insult": 0.6, "threat": 1.6, "target": 0.5, "boost": 0.3, "negated": -0.7, "reported": -0.5}
NEGATION_SCOPE = 3
_END = ".!?;"
_STRIP = "\"'()[]{}<>*#$%&~_-+=|/\\:,„“”«»…" + _END
_ENDS, _QUOTES = frozenset(_END), "\"')]}”»"
_ROOM = 300_000


def negation(state: int, symbol: int) -> tuple[int, bool]:
    """Transducer: how many words the negation still covers; marks attacks within its scope."""
    return (NEGATION_SCOPE if symbol == NEGATION else max(0, state - 1)), state > 0


def report(state: int, symbol: int) -> tuple[int, bool]:
    """Transducer: once someone is quoted, the rest of the clause is theirs."""
    return int(state or symbol == REPORT), bool(state)


def target(state: int, symbol: int) -> tuple[int, bool]:
    """Transducer: whether the clause has named a target so far."""
    return int(state or symbol == TARGET), bool(state)


def boost(state: int, symbol: int) -> tuple[int, bool]:
    """Transducer: a boost strengthens an attack within the next two words."""
    return (2 if symbol == BOOST else max(0, state - 1)), state > 0


PARTS = (negation, report, target, boost)


@dataclass
class Automaton:
    """The product of PARTS, and on top whether an attack waits for its target; built by exploring all reachable states."""

    step: dict[tuple[int, int], tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self):
        numbers, todo = {(0, 0, 0, 0, 0): 0}, [(0, 0, 0, 0, 0)]
        while todo:
            state = todo.pop()
            for symbol in range(7):
                nxt, marks = zip(*(part(s, symbol) for part, s in zip(PARTS, state)))
                waits, weight = state[4], 0.0
                negated, reported, aimed, boosted = marks
                if symbol == INSULT or symbol == THREAT and not state[4]:
                    factor = WEIGHTS["insult" if symbol == INSULT else "threat"] + WEIGHTS["target"] * aimed + WEIGHTS["boost"] * boosted + WEIGHTS["negated"] * negated + WEIGHTS["reported"] * reported
                    # a threat counts once its target follows
                    weight, waits = (factor, 1 if not aimed else 2) if symbol == INSULT else (0.0, 3 + negated + 2 * reported)
                elif symbol == TARGET and waits == 1:
                    weight, waits = WEIGHTS["target"], 2
                elif symbol == TARGET and waits >= 3:
                    weight, waits = WEIGHTS["threat"] + WEIGHTS["negated"] * (waits in (4, 6)) + WEIGHTS["reported"] * (waits >= 5), 2
                following = (*nxt, waits)
                if following not in numbers:
                    numbers[following] = len(numbers)
                    todo.append(following)
                self.step[numbers[state], symbol] = (numbers[following], weight)

    def weigh(self, symbols: list[tuple[int, float]]) -> float:
        """The weight of one clause: (symbol, lexical weight) in order; 0 without a match."""
        state, total = 0, 0.0
        for symbol, lexical in symbols:
            state, weight = self.step[state, symbol]
            if weight:
                total += max(0.05, weight) * (lexical if symbol == INSULT else 1.0)
        return total


_AUTOMATON = Automaton()


@dataclass(frozen=True)
class ToxicityGrammar:
    """Insult terminals with weights (words, and stems that any ending may follow) and the curve of the score."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 2.0
    offset: float = -2.0

    def lexer(self) -> "_Lexer":
        return _Lexer(self)

    def score_of(self, weight: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * math.log1p(weight)))))


def words_and_lines(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, and after how many of them each of its lines ends."""
    words: list[str] = []
    lines = []
    for line in text.split("\n"):
        words += line.split()
        lines.append(len(words))
    return words, lines


class _Lexer(dict):
    """raw word -> 0, or 1 + index of (symbol, weight, ends its clause); remembered within a bound."""

    def __init__(self, grammar: ToxicityGrammar):
        super().__init__()
        self.grammar = grammar
        self.closed = {w: s for s, names in CLOSED.items() for w in names.split()}
        self.lengths = sorted({len(s) for s in grammar.stems})
        self.kinds: list[tuple[int, float, bool]] = []
        self.index: dict[tuple[int, float, bool], int] = {}

    def __missing__(self, raw: str) -> int:
        word = raw.strip(_STRIP).lower()
        kind, weight = self.closed.get(word, OTHER), 0.0
        if kind == OTHER:
            weight = self.grammar.words.get(word, 0.0) or max((self.grammar.stems.get(word[:n], 0.0) for n in self.lengths), default=0.0)
            kind = INSULT if weight else OTHER
        ends = raw.rstrip(_QUOTES)[-1:] in _ENDS
        key = (kind, weight, ends)
        code = self.index.setdefault(key, len(self.kinds) + 1)
        if code > len(self.kinds):
            self.kinds.append(key)
        if len(self) >= _ROOM:
            self.clear()
        if len(raw) <= 64:
            self[raw] = code
        return code

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(first word, word after the last, weight) of every matched clause of the whole text."""
        words, lines = words_and_lines(text)
        codes = np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))
        attack = np.array([False] + [k in (INSULT, THREAT) for k, *_ in self.kinds])
        ends = np.array([False] + [e for *_, e in self.kinds])
        hits = np.flatnonzero(attack[codes])
        if not len(hits):
            return []
        stops = np.union1d(np.flatnonzero(ends[codes]) + 1, lines)
        starts = np.unique(np.concatenate([[0], stops])[np.searchsorted(stops, hits, side="right")])
        out = []
        for a in starts.tolist():
            k = np.searchsorted(stops, a, side="right")
            b = int(stops[k]) if k < len(stops) else len(words)
            weight = _AUTOMATON.weigh([self.kinds[c - 1][:2] for c in codes[a:b].tolist()])
            if weight:
                out.append((a, b, weight))
        return out

    def weight(self, text: str) -> float:
        return sum(w for *_, w in self.clauses(text))


def _lexemes(text: str) -> set[str]:
    """Words and stems (marked by ``*``) of a text."""
    words = {w.strip(_STRIP).lower() for w in text.split()}
    words = {w for w in words if 2 < len(w) <= 40}
    return words | {w[:n] + "*" for w in words for n in range(3, 11) if len(w) > n}


def _copies_aside(sample: DataFrame) -> list[int]:
    """Ids of the sample without later near copies: rows that share one of three minima of hashed word triples with an earlier one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh32_intdigest

        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                w = text.lower().split()
                h = np.fromiter((xxh32_intdigest(" ".join(t)) for t in zip(w, w[1:], w[2:])), dtype=np.uint64) if len(w) > 2 else np.array([xxh32_intdigest(" ".join(w))], dtype=np.uint64)
                rows.append((doc, *(int(((h * np.uint64(2654435761 + 40_503 * 2 * k + 2 * k)) & np.uint64(0xFFFFFFFF)).min()) for k in range(3))))
            yield pd.DataFrame(rows, columns=["doc_id", "a", "b", "c"])

    # three numbers a sampled row, fit_rows of them at most
    rows = sample.select("doc_id", "text").mapInPandas(run, "doc_id long, a long, b long, c long").toPandas().sort_values("doc_id")
    seen: set[tuple[int, int]] = set()
    kept = []
    for doc, *minima in rows.itertuples(index=False):
        keys = {(k, m) for k, m in enumerate(minima)}
        if not keys & seen:
            kept.append(int(doc))
        seen |= keys
    return kept


def _telling(sample: DataFrame, kept, grammar: ToxicityGrammar | None, most_clean: float, terminals: int) -> tuple[int, int, list]:
    """Clean and toxic documents that ``grammar`` does not match yet, and the lexemes found in at least four of the toxic ones and in few clean ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        rows, lexer = Counter(), grammar.lexer() if grammar else None
        for batch in batches:
            for doc, text, mark in zip(batch["doc_id"], batch["text"], batch["label"]):
                if doc in kept.value and (lexer is None or not lexer.weight(text)):
                    found[min(1, mark)].update(_lexemes(text))
                    rows[min(1, mark)] += 1
        found[0][""], found[1][""] = rows[0], rows[1]
        names = sorted(found[0].keys() | found[1].keys())
        yield pd.DataFrame({"lexeme": names, "clean": [found[0][w] for w in names], "toxic": [found[1][w] for w in names]})

    counts = sample.mapInPandas(count, "lexeme string, clean long, toxic long").groupBy("lexeme").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    some = counts.filter((F.col("lexeme") == "") | (F.col("toxic") >= 4) & (F.col("clean") <= most_clean * F.col("toxic")))
    rows = some.orderBy(F.col("lexeme") != "", F.desc(F.col("toxic") - F.col("clean")), "lexeme").limit(terminals + 1).collect()
    totals = [r for r in rows if r["lexeme"] == ""]
    return (totals[0]["clean"], totals[0]["toxic"], [r for r in rows if r["lexeme"]]) if totals else (0, 0, [])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, fit_rows: int = 12_000, terminals: int = 4000) -> ToxicityGrammar:
    """Learn insult terminals (``terminals`` at most, the most telling ones) and the curve."""
    spark = docs.sparkSession
    seed = {w: 1.0 for w in SEED_INSULTS.split()}
    sample = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, fit_rows)
    kept = spark.sparkContext.broadcast(frozenset(_copies_aside(sample)))

    words, stems = dict(seed), {}
    # first what is (almost) never clean; then, in documents without any of it, weaker evidence
    for most_clean in (0.05, 1.0):
        clean, toxic, telling = _telling(sample, kept, ToxicityGrammar(words, stems) if stems or len(words) > len(seed) else None, most_clean, terminals)
        if not clean or not toxic:
            if most_clean < 1:
                return ToxicityGrammar(seed, {})
            break
        base, taken = toxic / (toxic + clean), {}
        for lexeme, n_clean, n_toxic in sorted(telling, key=lambda r: (-len(r[0]), r[0])):
            # chance that so many of the documents with it are toxic by the base rate alone, for a hundred thousand candidates
            n = n_clean + n_toxic
            log_p = math.lgamma(n + 1) - math.lgamma(n_clean + 1) - math.lgamma(n_toxic + 1) + n_toxic * math.log(base) + n_clean * math.log(1 - base)
            name = lexeme.rstrip("*")
            # a stem that one longer terminal already covers adds nothing but accidents
            if n_toxic < base * n or log_p >= math.log(1e-7) or lexeme != name and taken.get(name, 0) >= 0.9 * n_toxic:
                continue
            weight = max(0.2, 0.4 * (math.log((n_toxic + 0.5) / (n_clean + 0.5)) - 0.5))
            (words if lexeme == name else stems)[name] = weight
            for k in range(3, len(name) + (lexeme == name)):
                taken[name[:k]] = max(taken.get(name[:k], 0), n_toxic)
    grammar = ToxicityGrammar(words, stems)
    shared = spark.sparkContext.broadcast(grammar)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexer = shared.value.lexer()
        for batch in batches:
            yield pd.DataFrame({"x": [math.log1p(lexer.weight(t)) for t in batch["text"]], "y": batch["label"].clip(0, 1).astype("int32")})

    # two numbers a sampled row
    points = sample.mapInPandas(weigh, "x double, y int").toPandas()
    slope, offset = _curve(points["x"].to_numpy(), points["y"].to_numpy(dtype=float))
    return ToxicityGrammar(words, stems, slope, offset)


def _curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, float]:
    """Logistic fit of one variable by Newton steps, with a small penalty that keeps separable data finite; never falling."""
    a, b = 0.0, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p)
        gradient = np.array([(y - p).sum(), ((y - p) * x).sum() - penalty * b])
        hessian = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + penalty]])
        move = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-9:
            break
    return max(0.1, float(b)), float(a)


def score(docs: DataFrame, grammar: ToxicityGrammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), clauses (how many matched) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexer = shared.value.lexer()
        for batch in batches:
            found = [[w for *_, w in lexer.clauses(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [shared.value.score_of(sum(f)) for f in found], "clauses": [len(f) for f in found]})

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, score double, clauses long")


def matches(docs: DataFrame, grammar: ToxicityGrammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every matched clause: doc_id, clause (its text), weight."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexer = shared.value.lexer()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                words = text.split()
                found = [(doc, " ".join(words[a:b]), w) for a, b, w in lexer.clauses(text)]
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "clause", "weight"]).astype({"doc_id": "Int64"})

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, clause string, weight double")


def accepted(docs: DataFrame, grammar: ToxicityGrammar, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexer = shared.value.lexer()
        for text in parts:
            yield pd.Series([shared.value.score_of(lexer.weight(t)) for t in text], dtype=float)

    return docs.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) < threshold)


def learn_fold(mod: int = 4, held_out: int = 2) -> Column:
    return crc_mod(F.col("doc_id"), mod) != held_out
