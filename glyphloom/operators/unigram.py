"""Unigram pieces: expectation-maximization over the unit table, and best-path encoding."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.functions.lattice import Automaton
from glyphloom.functions.segment import best_path, digamma, digammas, with_prefixes
from glyphloom.functions.text import PRETOKEN_SPECIALS, SPECIALS, UNK, pretokens
from glyphloom.operators.stream import Joining
from glyphloom.operators.narrow import encode_in_place
from glyphloom.operators.subword import fuse_unknown, special_ids, subword_decode
from glyphloom.session import checkpointed

# Fixed values of the training method.
LONGEST_PIECE = 16
SHRINK = 0.75
SUB_ROUNDS = 2
LEAST_EXPECTED = 0.5
UNKNOWN_PENALTY = 10.0
UNITS = 20_000  # units whose lattices a task holds at once


@dataclass(frozen=True)
class UnigramModel:
    """``pieces(id, piece, log_prob)``: specials first, then pieces by falling score."""

    pieces: DataFrame
    vocab_size: int

    @property
    def vocab(self) -> DataFrame:
        return self.pieces.select("id", F.col("piece").alias("token"))

    def segmenter(self):
        """A function unit -> ids; holds at most ``vocab_size`` pieces."""
        rows = self.pieces.where(F.col("id") >= len(SPECIALS)).collect()
        ids = {r.piece: r.id for r in rows}
        scores = {r.piece: r.log_prob for r in rows}
        known = with_prefixes(scores)
        # Special tokens carry score 0, so they do not lower the minimum.
        unknown = min([0.0, *scores.values()]) - UNKNOWN_PENALTY

        def segment(unit: str) -> list[int]:
            special = special_ids(unit)
            if special:
                return special
            spans, _ = best_path(unit, known, unknown)
            return fuse_unknown([ids.get(unit[a:b], UNK) for a, b in spans])

        return segment

    def joining(self) -> Joining:
        return Joining()


def unigram_encode(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """``(split, doc_id, ids)`` without begin and end ids."""
    return encode_in_place(docs, pretokens(F.col("text"), PRETOKEN_SPECIALS), model.segmenter())


def unigram_decode(encoded: DataFrame, model: UnigramModel,
                   skip_specials: bool = True) -> DataFrame:
    return subword_decode(encoded, model.vocab, skip_specials=skip_specials)


def substring_seed(units: DataFrame, seed_size: int,
                   longest: int = LONGEST_PIECE) -> DataFrame:
    """``(piece, n, score)``: the best substrings of 2..``longest`` characters.

    Substrings seen at least twice, by frequency times length.  Each place of a unit sends
    its next characters once, added up in the task, to the part of its first three; there
    they arrive sorted, so the counts of all their beginnings are the totals of the branches
    that close.  Only repeated substrings come out, each once.
    """
    def suffixes(batches):
        for batch in batches:
            counts: Counter = Counter()
            for unit, n in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(len(unit) - 1):
                    counts[unit[at:at + longest]] += n
            yield pa.record_batch([pa.array(list(counts), pa.string()),
                                   pa.array(list(counts.values()), pa.int64())], ["ahead", "n"])

    def branches(batches):
        path, totals, out = "", [], []  # totals[i]: occurrences below path[:i + 1]

        def close(depth):
            while len(totals) > depth:
                n = totals.pop()
                size = len(totals) + 1
                # Two characters may be shared with another part: added up at the end.
                if size == 2 or size > 2 and n >= 2:
                    out.append((path[:size], n))
                if totals:
                    totals[-1] += n

        def rows():
            found = pa.record_batch([pa.array([o[0] for o in out], pa.string()),
                                     pa.array([o[1] for o in out], pa.int64())], ["piece", "n"])
            out.clear()
            return found

        for batch in batches:
            for ahead, n in zip(*(c.to_pylist() for c in batch.columns)):
                shared = 0
                for x, y in zip(path, ahead):
                    if x != y:
                        break
                    shared += 1
                close(shared)
                path = ahead
                totals += [0] * (len(ahead) - len(totals))
                totals[-1] += n
            if out:
                yield rows()
        close(0)
        yield rows()

    ahead = units.where(F.char_length("unit") > 1).select("unit", "n").mapInArrow(
        suffixes, "ahead string, n bigint")
    dealt = ahead.repartition(F.left("ahead", F.lit(3))).sortWithinPartitions("ahead")
    found = dealt.mapInArrow(branches, "piece string, n bigint")
    short = F.char_length("piece") == 2
    pieces = found.where(~short).unionAll(
        found.where(short).groupBy("piece").agg(F.sum("n").alias("n")).where("n >= 2"))
    return pieces.withColumn("score", F.col("n") * F.length("piece")).orderBy(
        F.desc("score"), "piece").limit(seed_size)


def _uses(units: DataFrame, automaton, scores: np.ndarray, kind: str) -> np.ndarray:
    """Uses of each piece over all units, by number: one sum per task, then one per piece.

    ``kind`` is ``expected``, over all segmentations, or ``used``, on the best ones.  Tasks
    share the automaton and the scores, which the number of pieces bounds.
    """
    # Plain arrays: executors need not know the class to read them.
    parts = tuple(getattr(automaton, f.name) for f in fields(automaton))
    shared, costs = (units.sparkSession.sparkContext.broadcast(x) for x in (parts, scores))

    def run(batches):
        automaton, total = Automaton(*shared.value), np.zeros(len(costs.value))
        for batch in batches:
            texts, weights = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
            for at in range(0, len(texts), UNITS):
                lattice = automaton.lattice(texts[at:at + UNITS])
                getattr(lattice, kind)(costs.value, weights[at:at + UNITS], total)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["number", "uses"])

    rows = units.select("unit", "n").mapInArrow(run, "number bigint, uses double").groupBy(
        "number").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(len(scores))
    out[rows["number"].to_numpy()] = rows["uses"].to_numpy()
    shared.unpersist()
    costs.unpersist()
    return out


def expected_piece_uses(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(piece, uses)``: uses of each of ``(piece, log_prob)`` expected over all
    segmentations of ``(unit, n)``, which the pieces must cover."""
    rows = sorted(map(tuple, pieces.select("piece", "log_prob").collect()))
    names = [p for p, _ in rows]
    uses = _uses(units, Automaton.of(names), np.array([s for _, s in rows], float), "expected")
    return units.sparkSession.createDataFrame(
        pd.DataFrame({"piece": names, "uses": uses}), "piece string, uses double")


def given_model(pieces: DataFrame) -> UnigramModel:
    """A model of ``(piece, log_prob)`` behind the specials, by falling score, then piece."""
    rows = sorted(map(tuple, pieces.select("piece", "log_prob").collect()),
                  key=lambda r: (-r[1], r[0]))
    return _numbered(pieces.sparkSession, rows)


def _numbered(spark, final: list[tuple[str, float]]) -> UnigramModel:
    rows = [(t, 0.0) for t in SPECIALS] + final
    return UnigramModel(spark.createDataFrame(
        pd.DataFrame({"id": range(len(rows)), "piece": [r[0] for r in rows],
                      "log_prob": [r[1] for r in rows]}),
        "id int, piece string, log_prob double"), len(rows))


def _reestimate(units: DataFrame, automaton, scores: np.ndarray,
                letters: np.ndarray) -> np.ndarray:
    """One expectation-maximization step; rare pieces go (score -inf), characters stay."""
    uses = _uses(units, automaton, scores, "expected")
    kept = (uses >= LEAST_EXPECTED) | letters & (uses > 0)
    counts = np.maximum(uses, LEAST_EXPECTED)
    norm = digamma(math.fsum(counts[kept].tolist()))
    # Rounded so that the order of partial sums cannot show.
    return np.where(kept, np.round(digammas(counts) - norm, 9), -np.inf)


def _prune(units: DataFrame, automaton, scores: np.ndarray, pieces: list[str],
           letters: np.ndarray, size: int) -> np.ndarray:
    """Scores of the ``size`` pieces whose removal would cost most; characters always stay.

    Without a piece, its uses on best paths fall to its own best split into others.
    """
    uses = _uses(units, automaton, scores, "used")
    loss = np.full(len(scores), -np.inf)
    some = np.flatnonzero((uses > 0) & ~letters)
    for at in range(0, len(some), UNITS):
        part = some[at:at + UNITS]
        lattice = automaton.lattice([pieces[i] for i in part])
        lattice = lattice.without(lattice.whole())
        split = lattice.best(scores)[0][lattice.first[1:] - 1]
        loss[part] = uses[part] * (scores[part] - split)
    room = max(size - int(letters.sum()), 0)
    # Pieces are numbered in order, so the sort settles equal losses by piece.
    best = some[np.argsort(-np.round(loss[some], 6), kind="stable")][:room]
    keep = letters.copy()
    keep[best] = True
    return np.where(keep, scores, -np.inf)


def unigram_train(units: DataFrame, vocab_size: int = 5000,
                  seed_size: int = 1_000_000, longest: int = LONGEST_PIECE) -> UnigramModel:
    """Learn pieces from ``(unit, n)``.

    Seed with the ``seed_size`` best substrings of up to ``longest`` characters, then
    alternate re-estimation and pruning until the target is near, and cut to it by score.
    Units stay distributed; the driver holds numbers by piece only, at most ``seed_size``
    plus the characters, as arrays.
    """
    spark = units.sparkSession
    # As many parts as the counts have: every pass is one task a part, and there are dozens.
    units = checkpointed(units.select("unit", "n"))
    singles = units.select("n", F.explode(F.split("unit", "")).alias("piece")).groupBy(
        "piece").agg(F.sum("n").alias("score")).toArrow()
    seeds = substring_seed(units, seed_size, longest).select("piece", "score").toArrow()
    pieces = singles["piece"].to_pylist() + seeds["piece"].to_pylist()
    raw = np.concatenate([t["score"].to_numpy().astype(float) for t in (singles, seeds)])
    order = sorted(range(len(pieces)), key=pieces.__getitem__)
    letters = np.array(order, np.int64) < singles.num_rows
    pieces, raw = [pieces[i] for i in order], raw[order]
    scores = np.log(raw) - math.log(math.fsum(raw.tolist())) if len(raw) else raw
    target = max(vocab_size - len(SPECIALS), int(letters.sum()))
    near = int(target * 1.1)
    automaton, built = Automaton.of(pieces), len(pieces)
    while len(pieces):
        for _ in range(SUB_ROUNDS):
            scores = _reestimate(units, automaton, scores, letters)
        left = int(np.isfinite(scores).sum())
        if left <= near:
            break
        scores = _prune(units, automaton, scores, pieces, letters, max(near, int(left * SHRINK)))
        live = np.isfinite(scores)
        if live.sum() < 0.8 * built:  # the dead pieces only cost time
            pieces = [p for p, on in zip(pieces, live.tolist()) if on]
            scores, letters = scores[live], letters[live]
            automaton, built = Automaton.of(pieces), len(pieces)
    scored = [(p, float(s), one) for p, s, one in zip(pieces, scores, letters) if s > -math.inf]
    scored.sort(key=lambda p: (-p[1], p[0]))
    extra = [p for p in scored if not p[2]][:target - sum(one for *_, one in scored)]
    final = sorted([p for p in scored if p[2]] + extra, key=lambda p: (-p[1], p[0]))
    return _numbered(spark, [p[:2] for p in final])
