"""Language identification by cross-parsing: how few phrases of a language's labelled text spell a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fold, table

#: Characters of labelled text in a language's automaton, of one document at most PIECE. This is the bounded sample that is fitted on.
SAMPLE, PIECE = 20_000, 1_000
#: A document is parsed in blocks of so many characters; phrases don't cross blocks.
BLOCK = 2_048
_GROUP = 4 << 20
UNKNOWN = "und"


def _automaton(text: list[int]) -> list[dict[int, int]]:
    """For each state of the smallest automaton of all substrings of ``text`` the next state by letter; state 0 is its start."""
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] != length[p] + 1:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return moves


def suffix_automaton(text: list[int], width: int) -> np.ndarray:
    """Transitions (state x letter, -1 where there is none) of the smallest automaton of all substrings of ``text``; state 0 is its start."""
    moves = _automaton(text)
    table = np.full((len(moves), width), -1, np.int32)
    for s, m in enumerate(moves):
        table[s, list(m)] = list(m.values())
    return table


@dataclass(frozen=True)
class Transitions:
    """Transitions of all states, of any number of letters, in one array: a state's are at its ``row`` plus the letter, where ``owner`` names it.

    Indexed by state (times 2 ** shift) plus letter: twice the next state (times 2 ** shift) and, in the lowest bit, whether a phrase ended
    before this letter. ``fresh`` holds, by language and letter, where a new phrase goes.
    """

    shift: int
    row: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    language: np.ndarray
    fresh: np.ndarray

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        flat = np.asarray(index).ravel()
        state, letter = flat >> self.shift, flat & ((1 << self.shift) - 1)
        slot = self.row[state] + letter
        found = self.to[slot].astype(np.int64) << (self.shift + 1)
        miss = np.flatnonzero(self.owner[slot] != state)
        found[miss] = (self.fresh[self.language[state[miss]], letter[miss]].astype(np.int64) << (self.shift + 1)) | 1
        return found.reshape(np.shape(index))


def _transitions(automata: list[list[dict[int, int]]], width: int) -> tuple[Transitions, np.ndarray]:
    """The automata's transitions and their starts: states with several letters take the first place where all are free, the others what is left."""
    shift = max(1, int(width - 1).bit_length())
    starts = np.cumsum([0] + [len(a) for a in automata])
    total = sum(len(m) for a in automata for m in a)
    row = np.full(int(starts[-1]), 0, np.int64)
    free = np.ones(2 * total + 4 * width, bool)
    low = width
    step = 1_024
    slots, owners, nexts, single = [], [], [], []
    for base, automaton in zip(starts.tolist(), automata):
        for s in sorted(range(len(automaton)), key=lambda s: -len(automaton[s])):
            moves = automaton[s]
            if len(moves) < 2:
                single += [(base + s, c, base + q) for c, q in moves.items()]
                continue
            letters = sorted(moves)
            at = low
            while True:
                if at + step + width > len(free):
                    free = np.append(free, np.ones(len(free) + step + width, bool))
                fits = free[at : at + step].copy()
                for c in letters[1:]:
                    fits &= free[at + c - letters[0] : at + c - letters[0] + step]
                if fits.any():
                    break
                at += step
            row[base + s] = at + int(fits.argmax()) - letters[0]
            for c in letters:
                slots.append(int(row[base + s]) + c)
                owners.append(base + s)
                nexts.append(base + moves[c])
            free[slots[-len(letters) :]] = False
            low = max(low, at - 8 * step)
    left = width + np.flatnonzero(free[width:])
    if len(left) < len(single):
        left = np.append(left, len(free) + np.arange(len(single) - len(left)))
    for slot, (s, c, q) in zip(left.tolist(), single):
        row[s] = slot - c
        slots.append(slot)
        owners.append(s)
        nexts.append(q)
    owner = np.full(max(slots, default=0) + 2 * width, -1, np.int32)
    to = np.zeros(len(owner), np.int32)
    owner[slots], to[slots] = owners, nexts
    fresh = np.repeat(starts[:-1, None], width, axis=1).astype(np.int32)
    for k, automaton in enumerate(automata):
        fresh[k, list(automaton[0])] = [starts[k] + q for q in automaton[0].values()]
    language = np.repeat(np.arange(len(automata), dtype=np.int32), np.diff(starts))
    return Transitions(shift, row, owner, to, language, fresh), starts[:-1].astype(np.int64) << shift


@dataclass(frozen=True)
class Languages:
    """codes: a letter class for each code point (0: no letter, 1: a letter that no language has). parser: for each state (of a language's
    automaton) and class the next state and whether a phrase ended before this letter."""

    names: list[str]
    codes: np.ndarray
    width: int
    parser: Transitions
    starts: np.ndarray
    bits: np.ndarray

    def letters(self, text: str) -> np.ndarray:
        c = self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        return c[(c != 0) | np.append(True, c[:-1] != 0)] if len(c) else c

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases by language (rows) and document (columns): all documents advance letter by letter together."""
        cuts = [(d, at) for d, c in enumerate(coded) for at in range(0, len(c), BLOCK)]
        sizes = np.array([min(BLOCK, len(coded[d]) - at) for d, at in cuts], np.int64)
        total = np.zeros((len(self.names), len(coded)), np.int64)
        if not cuts:
            return total
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((len(cuts), int(sizes.max())), np.uint32)
        for row, i in enumerate(order):
            d, at = cuts[i]
            grid[row, : sizes[i]] = coded[d][at : at + BLOCK]
        grid = np.ascontiguousarray(grid.T)
        sizes = sizes[order]
        state = np.repeat(self.starts[:, None], len(cuts), axis=1)
        count = np.ones(state.shape, np.int32)  # the phrase that is open at the end
        active = np.searchsorted(-sizes, -np.arange(grid.shape[0]), side="left")  # blocks longer than each step
        for step, n in enumerate(active.tolist()):
            move = self.parser[state[:, :n] + grid[step, :n]]
            count[:, :n] += move & 1
            state[:, :n] = move >> 1
        owner = np.array([cuts[i][0] for i in order])
        for language in range(len(self.names)):
            total[language] = np.bincount(owner, weights=count[language], minlength=len(coded)).astype(np.int64)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, coded, room = [], [], _GROUP

        def flush() -> None:
            if coded:
                cost = self.phrases(coded) * self.bits[:, None]
                best = cost.argmin(axis=0)  # equal: the language with more labelled documents
                share = (1 / cost[best, np.arange(len(coded))]) / (1 / cost).sum(axis=0)
                out.extend((self.names[b], float(s)) if c.any() else (UNKNOWN, 0.0) for b, s, c in zip(best, share, coded))
                coded.clear()

        for text in texts:
            coded.append(self.letters(text or ""))
            if not coded[-1].any():
                coded[-1] = np.zeros(1, np.uint32)
            room -= len(coded[-1])
            if room <= 0:
                flush()
                room = _GROUP
        flush()
        return out


def _samples(docs: DataFrame, sample: int, piece: int) -> dict[str, str]:
    """Up to ``sample`` characters of each language's texts, the language of most documents first."""
    size = F.least(F.length("text"), F.lit(piece)) + 1
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).orderBy(F.col("n").desc(), "lang").collect()
    share = {r["lang"]: 4 * sample / r["size"] for r in counts}
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    begin = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.greatest(F.length("text") - piece + 1, F.lit(1))).cast("int") + 1
    texts = {r["lang"]: "" for r in counts}
    short = list(texts)
    while short:
        shares = docs.sparkSession.createDataFrame([(x, share[x]) for x in short], "l string, share double")
        some = docs.join(F.broadcast(shares), F.col("lang") == F.col("l")).select("lang", drawn.alias("u"), "share", "doc_id", F.substring("text", begin, F.lit(piece)).alias("text"))
        rows = some.where("u < share").select("lang", "u", "doc_id", "text").distinct().collect()
        texts |= dict.fromkeys(short, "")
        for r in sorted(rows, key=lambda r: (r["u"], str(r["doc_id"]), r["text"])):
            if len(texts[r["lang"]]) < sample:
                texts[r["lang"]] = (texts[r["lang"]] + " " + r["text"])[:sample]
        short = [x for x in short if len(texts[x]) < sample and share[x] < 1]
        share |= {x: 8 * share[x] for x in short}
    return texts


def fit(docs: DataFrame, sample: int = SAMPLE, piece: int = PIECE) -> Languages | None:
    """Automata over ``sample`` characters of each language's labelled texts, of all if there are fewer; None without labelled text. Documents
    are drawn by a hash of id and text until the sample is full, and of each up to ``piece`` characters from anywhere in it are learned. All
    letters of all samples are told apart. The model has some 0.5 MB for each language, and parsing takes time in proportion to languages."""
    texts = _samples(docs, sample, piece)
    names = [n for n, t in texts.items() if any(map(str.isalpha, t))]
    if not names:
        return None
    seen = sorted({c for n in names for c in texts[n].lower() if c.isalpha()})
    classes = {c: i + 2 for i, c in enumerate(seen)}
    codes = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            codes[i] = classes.get(c.lower()[0], 1)
    width = len(seen) + 2
    shell = Languages(names, codes, width, None, np.zeros(0, np.int64), np.zeros(0))
    coded = [shell.letters(texts[n]) for n in names]
    parser, starts = _transitions([_automaton(c.tolist()) for c in coded], width)
    return Languages(names, codes, width, parser, starts, np.array([np.log2(max(2, len(c))) for c in coded]))


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learned from rows with a text and a language, of all languages, whose id is not in the held-out fold (a null id is in none). A text is cut greedily into
    the longest phrases that occur in a language's labelled text; the language wins whose phrases, times the bits that name a place in its
    text, are fewest. Letters are compared in lower case, and all between words counts as one space. Whole texts are parsed, in blocks.
    Null texts and those without letters, and all if nothing was learned, are ``und`` with score 0; else the score is the winner's share
    of the inverse costs. Repeated rows get equal results.
    """
    bound_batches(docs.sparkSession, 2_000)
    model = fit(docs.where("lang is not null and text is not null").where(F.coalesce(fold(F.col("doc_id")) != 0, F.lit(True))).select("doc_id", "text", "lang"), sample)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(text.tolist()), columns=["lang_pred", "score"])

    return docs.select("doc_id", held, of("text").alias("x")).select("doc_id", "held_out", "x.lang_pred", "x.score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
