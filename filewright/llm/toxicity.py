"""Toxicity from a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report or other. Small
machines follow negation, targets and reported speech; their composition is one
transducer that reads a clause and writes what each insult or threat in it is:
plain, negated or reported, aimed at someone or not. Insults are stems learned
from labelled texts, with their log odds as weights, and the weights of what the
transducer writes are fitted by logistic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.llm.store import may_match, passing, stage
from filewright.llm.text import trimmed

MAX_TRAINING_TEXTS = 20_000
STEMS = range(4, 9)
SIGNATURES = 4
EXPLAIN_ROUNDS = 3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Words known beforehand, in English, German, French and Spanish. Learned odds replace the weight of those seen in training.
KNOWN = {
    INSULT: "idiot stupid moron loser scum trash worthless pathetic disgusting clown dumb imbecile",
    THREAT: "kill hurt destroy shoot strangle töten umbringen tuer frapper matar golpear",
    TARGET: "you your yours he she they du dich dir euch ihr tu toi vous tú ti usted ustedes",
    NEGATION: "not no never nor isn't aren't nicht kein keine nie pas jamais aucun nunca ningún",
    REPORT: "said says told wrote claimed reported quoted sagte schrieb dit écrit dijo escribió",
}
SYMBOLS = {word: symbol for symbol, words in KNOWN.items() for word in words.split() if symbol > THREAT}
KNOWN_WEIGHT = 3.0

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n,]")
BREAKS = ".!?;:\n,"

# A machine has a start state and gives the next state for a state and a symbol.
NEGATION_REACH = 3
MACHINES = (
    (0, lambda state, symbol: NEGATION_REACH if symbol == NEGATION else max(state - 1, 0), range(NEGATION_REACH + 1)),
    (0, lambda state, symbol: 1 if symbol == REPORT else state, range(2)),
    (0, lambda state, symbol: 1 if symbol == TARGET else state, range(2)),
)
FEATURES = ("weight", "clauses", "negated", "reported", "aimed", "threats", "bias")
# Where the fit starts and what holds without training: a matched insult is toxic, less so if negated or reported.
PRIOR = np.array([1.0, 1.0, -0.5, -0.5, 0.3, 0.5, -3.0])


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The transducer of all machines: next state and output by (state, symbol); output is 1 for an event, plus 2 if negated, 4 if reported."""
    states = list(product(*(states for _, _, states in MACHINES)))
    number = {state: at for at, state in enumerate(states)}
    following = np.zeros((len(states), REPORT + 1), int)
    output = np.zeros_like(following)
    for state in states:
        for symbol in range(REPORT + 1):
            after = tuple(step(part, symbol) for part, (_, step, _) in zip(state, MACHINES))
            following[number[state], symbol] = number[after]
            if symbol in (INSULT, THREAT):
                output[number[state], symbol] = 1 + 2 * (state[0] > 0) + 4 * (state[1] > 0)
    return following, output


def _matcher(lexicon: dict[str, tuple[int, float]]) -> ahocorasick.Automaton:
    """Finds the stems (``stem*``) and words (``word$``) of the lexicon."""
    found = ahocorasick.Automaton()
    by_text: dict[str, list] = {}
    for key, (symbol, weight) in lexicon.items():
        by_text.setdefault(key[:-1], []).append((key[-1] == "*", symbol, weight))
    for text, uses in by_text.items():
        found.add_word(text, (len(text), uses))
    if by_text:
        found.make_automaton()
    return found


class Grammar:
    """Reads texts; built anew in each task from the lexicon."""

    def __init__(self, lexicon: dict[str, tuple[int, float]]):
        self.empty = not lexicon
        self.matcher = _matcher(lexicon)
        self.following, self.output = compose()

    def events(self, text: str) -> dict[int, tuple[int, float]]:
        """Start of each matched word: its symbol and weight."""
        found: dict[int, tuple[int, float]] = {}
        for end, (size, uses) in self.matcher.iter(text):
            start = end - size + 1
            if start and (text[start - 1].isalpha()):
                continue
            ends_word = end + 1 == len(text) or not text[end + 1].isalpha()
            for is_stem, symbol, weight in uses:
                if (is_stem or ends_word) and weight > found.get(start, (0, -1e9))[1]:
                    found[start] = symbol, weight
        return found

    def features(self, text: str | None) -> list[float]:
        made = [0.0] * len(FEATURES)
        made[-1] = 1.0
        text = (text or "").lower()
        if self.empty or not text:
            return made
        events = self.events(text)
        read_to, best, clauses, negated, reported, aimed, threats = 0, 0.0, 0, 0, 0, 0, 0
        for at in sorted(events):
            if at < read_to:
                continue
            begin = max(text.rfind(mark, read_to, at) for mark in BREAKS) + 1
            begin = max(begin, read_to)
            end = CLAUSE_END.search(text, at)
            read_to = end.start() if end else len(text)
            state, total, plain = 0, 0.0, False
            for word in WORD.finditer(text, begin, read_to):
                symbol, weight = events.get(word.start()) or (SYMBOLS.get(word.group(), OTHER), 0.0)
                wrote = self.output[state, symbol]
                state = self.following[state, symbol]
                if wrote:
                    plain |= wrote == 1
                    negated += bool(wrote & 2)
                    reported += bool(wrote & 4)
                    threats += symbol == THREAT
                    total = max(total, weight)
            clauses += plain
            aimed += state & 1
            best = max(best, total)
        made[:6] = [best, np.log1p(clauses), np.log1p(negated), np.log1p(reported), np.log1p(aimed), np.log1p(threats)]
        return made


def _signatures(words: list[str]) -> list[int]:
    """Least hashes of the runs of five words; near copies share some of them."""
    runs = {" ".join(words[at : at + 5]) for at in range(max(len(words) - 4, 1))}
    return [min(xxhash.xxh64_intdigest(run, seed) for run in runs) >> 1 for seed in range(SIGNATURES)]


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, signatures = [], []
        for text in batch.column(1).to_pylist():
            words = WORD.findall((text or "").lower())
            distinct = set(words)
            keys.append([*{w + "$" for w in distinct}, *{w[:n] + "*" for w in distinct for n in STEMS if len(w) >= n}])
            signatures.append(_signatures(words))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(signatures, pa.list_(pa.int64())),
                batch.column(2),
                pa.array(keys, pa.list_(pa.string())),
            ],
            ["number", "signatures", "toxic", "keys"],
        )


def training_texts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    limit: int = MAX_TRAINING_TEXTS,
) -> DataFrame:
    """(number, text, toxic) of labelled rows outside the held-out fifth, at most ``limit`` of them, chosen by a hash of the id."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .where(~held_out(F.col("id")))
        .withColumn("number", F.xxhash64(F.lit("training"), "id"))
    )
    share = min(1.0, 1.2 * limit / max(chosen.count(), 1))
    chosen = chosen.where(F.pmod("number", F.lit(1 << 20)) < share * (1 << 20)).orderBy("number").limit(limit)
    chosen = stage(chosen, "toxicity-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return may_match(texts, ["id"], chosen, ["id"]).join(chosen, "id").select("number", "text", "toxic")


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string")) % 5 == 0, F.lit(True))


def _kept(scanned: DataFrame) -> DataFrame:
    """Leave out near copies: a row stays if it is the first with each of its signatures."""
    signed = scanned.select("number", F.posexplode("signatures").alias("at", "signature"))
    first = signed.groupBy("at", "signature").agg(F.min("number").alias("number"))
    kept = first.groupBy("number").count().where(F.col("count") == SIGNATURES).select("number")
    return scanned.join(kept, "number", "left_semi").dropDuplicates(["number"])


def learn_lexicon(texts: DataFrame) -> dict[str, tuple[int, float]]:
    """Stems and words that labelled texts show to be insults, with their log odds.

    A key is taken if toxic texts hold it far more often than chance allows, given how
    many keys are tried; keys under a shorter stem that is taken are left out. Then the
    texts that the keys explain are set aside, and the rest are tried again.
    """
    scanned = stage(texts.mapInArrow(trimmed(_stems), "number bigint, signatures array<bigint>, toxic int, keys array<string>"), "stems")
    kept = stage(_kept(scanned), "kept-stems")
    totals = kept.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    count, toxic = totals["n"], totals["toxic"] or 0
    lexicon = {f"{word}$": (symbol, KNOWN_WEIGHT) for symbol in (INSULT, THREAT) for word in KNOWN[symbol].split()}
    if not 0 < toxic < count:
        return lexicon
    odds = lambda t, n: float(np.log((t + 0.5) / (toxic + 1)) - np.log((n - t + 0.5) / (count - toxic + 1)))
    for row in _key_counts(kept.withColumn("keys", F.array_intersect("keys", _listed(lexicon)))).collect():
        weight = odds(row["t"], row["n"])
        if weight > 0.5:
            lexicon[row["key"]] = lexicon[row["key"]][0], weight
        else:
            del lexicon[row["key"]]
    left = kept
    for _ in range(EXPLAIN_ROUNDS):
        left = left.where(~F.arrays_overlap("keys", _listed(lexicon))) if lexicon else left
        found = {row["key"]: (INSULT, odds(row["t"], row["n"])) for row in _surprising(left)}
        if not found:
            break
        for key in sorted(found, key=lambda key: (len(key), key)):
            text = key[:-1]
            if not any(f"{text[:n]}*" in lexicon for n in STEMS if n < len(text) or (n == len(text) and key[-1] == "$")):
                lexicon[key] = found[key]
    return lexicon


def _listed(keys) -> Column:
    return F.array(*(F.lit(key) for key in sorted(keys)))


def _key_counts(texts: DataFrame) -> DataFrame:
    """In how many texts and how many toxic texts a key is."""
    return texts.select(F.explode("keys").alias("key"), "toxic").groupBy("key").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    )


def _surprising(texts: DataFrame) -> list:
    """Keys that toxic texts among these hold more often than chance allows, over all keys tried."""
    totals = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not 0 < (totals["toxic"] or 0) < totals["n"]:
        return []
    base = totals["toxic"] / totals["n"]
    counted = stage(_key_counts(texts).where("n >= 3"), "keys")
    rate = F.col("t") / F.col("n")
    clean = 1 - rate
    surprise = F.col("n") * (
        rate * F.log(rate / base) + F.when(clean > 0, clean * F.log(clean / (1 - base))).otherwise(0.0)
    )
    return counted.where((rate >= 0.7) & (surprise > np.log(2.0 * max(counted.count(), 1)))).collect()


def _features(lexicon: dict[str, tuple[int, float]]):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            rows = [grammar.features(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(2)], ["features", "toxic"]
            )

    return made


def fit_weights(rows: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards ``PRIOR``."""
    weights = PRIOR.copy()
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (chance - toxic) + ridge * (weights - PRIOR)
        bend = (rows * (chance * (1 - chance))[:, None]).T @ rows + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


class Model:
    """A lexicon and the weights of the transducer's outputs."""

    def __init__(self, lexicon: dict[str, tuple[int, float]], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: Column) -> Column:
        """Chance that a text is toxic; NULL and empty texts get that of a text without a match."""
        lexicon, weights = self.lexicon, self.weights

        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            grammar = Grammar(lexicon)
            for texts in batches:
                rows = np.array([grammar.features(text) for text in texts], float).reshape(len(texts), len(FEATURES))
                yield pd.Series(1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30))))

        run = trimmed(scored)
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(text)


def train(texts: DataFrame) -> Model:
    """A model from (number, text, toxic). Without texts of both labels, the known words and prior weights hold."""
    with passing(texts.sparkSession):
        texts = stage(texts, "toxicity-training")
        lexicon = learn_lexicon(texts)
        rows = texts.mapInArrow(trimmed(_features(lexicon)), "features array<double>, toxic int").toPandas()
    if not 0 < rows["toxic"].sum() < len(rows):
        return Model(lexicon, PRIOR.copy())
    return Model(lexicon, fit_weights(np.stack(rows["features"].to_numpy()), rows["toxic"].to_numpy(float)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    Learns from at most ``MAX_TRAINING_TEXTS`` labelled texts outside the held-out
    fifth of the ids. A NULL id counts as held out. Labels that contradict each other
    count as toxic; labels without a document are unused. Repeated rows each get their
    result, and an empty table gives none.
    """
    model = train(training_texts(docs, labels, id_col, text_col))
    scored = docs.select(F.col(id_col).alias("id"), model.score(F.col(text_col)).alias("score"))
    return scored.select(
        "id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
