"""Quality rules from suffix arrays (operator 1).

The words of many texts are numbered and sorted by all their suffixes at once (prefix doubling, vectorised;
a suffix leaves the work as soon as it is alone in its group, and a text's number is part of its first
word, so texts never mix). Neighbouring suffixes give the longest common prefixes; runs of the LCP array at
or above ``min_words`` are the LCP intervals of the maximal repeated substrings. The spans of all their
occurrences are united. The rules limit the fraction of words inside that union and the longest repeat.

Defined results: a null or empty text has no words and fails; equal rows are judged alike and all stay or
all go; other columns are carried along untouched, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common


@dataclass(frozen=True)
class Rules:
    """``min_words``: shortest repeat that counts. A text fails with fewer than ``least_words`` words, with
    more than ``percent_covered`` % of its words in repeats, or if a repeat has over ``longest_words``."""

    min_words: int = 8
    least_words: int = 20
    percent_covered: int = 30
    longest_words: int = 100


def suffix_order(ids: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``ids`` within each text, and the ranks by the first 1, 2, 4, ... words.

    ``text``: number of the text of each word; ``ends``: where that text ends.
    """
    n = len(ids)
    first = text * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(first, kind="stable")
    at = np.arange(n)
    new = np.concatenate(([True], first[order][1:] != first[order][:-1]))[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    live = order[~(new & np.concatenate((new[1:], [True]))[:n])]
    levels, step = [rank.astype(np.int32)], 1
    while len(live):
        follow = live + step
        second = np.where(follow < ends[live], rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        old, i = rank[live], np.arange(len(live))
        group = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, i, 0))
        new = np.diff(key, prepend=-1) != 0
        order[old + i - group] = live
        rank[live] = old + np.maximum.accumulate(np.where(new, i, 0)) - group
        live = live[~(new & np.concatenate((new[1:], [True])))]
        levels.append(rank.astype(np.int32))
        step *= 2
    return order, levels


def repeat_lengths(ids: np.ndarray, text: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the words of the longest repeat of ``min_words`` or more that begins there (else 0),
    and whether its suffix opens an LCP interval."""
    longest, opens = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    if not len(ids):
        return longest, opens
    order, levels = suffix_order(ids, text, ends)
    base = min_words.bit_length() - 1
    if len(levels) <= base:
        return longest, opens
    at = np.flatnonzero(levels[base][order[1:]] == levels[base][order[:-1]])
    a, b = order[at], order[at + 1]
    lcp = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        inside = (i < ends[a]) & (j < ends[b])
        i, j = np.minimum(i, len(ids) - 1), np.minimum(j, len(ids) - 1)
        lcp += np.where(inside & (levels[k][i] == levels[k][j]), 1 << k, 0)
    enough = lcp >= min_words
    at, a, b, lcp = at[enough], a[enough], b[enough], lcp[enough]
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    opens[a[np.diff(at, prepend=-2) != 1]] = True
    return longest, opens


SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: list[bytes | None], rules: Rules) -> dict[str, np.ndarray]:
    """All measures and the verdict of each text of one chunk."""
    data, begins = common.lined_up(texts)
    white = common.WHITE[data]
    ids, n_words, starts, _ = common.word_table(data, white, begins)
    text = np.repeat(np.arange(len(texts)), n_words)
    last = np.cumsum(n_words)
    longest, opens = repeat_lengths(ids, text, last[text], rules.min_words)
    step = np.zeros(len(ids) + 1, np.int64)
    hit = np.flatnonzero(longest)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + longest[hit], -1)
    covered = np.cumsum(step[:-1]) > 0
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, text, longest)

    feeds = np.flatnonzero(data == 10)
    line_begin = np.concatenate(([0], feeds[:-1] + 1))
    line_ids, _ = common.exact_ids(data[data != 10], feeds - line_begin)
    has_word = np.searchsorted(starts, feeds) > np.searchsorted(starts, line_begin)
    if len(starts):  # a word never crosses a line feed, so a line has one if a word begins in it
        line_text = np.searchsorted(begins, line_begin, "right") - 1
        key = (line_text * (int(line_ids.max(initial=0)) + 1) + line_ids)[has_word]
        kinds = np.unique(key)
        n_dup = np.bincount(line_text[has_word], minlength=len(texts)) - np.bincount(kinds // (int(line_ids.max(initial=0)) + 1), minlength=len(texts))
    else:
        n_dup = np.zeros(len(texts), np.int64)

    out = {
        "n_words": n_words,
        "word_chars": common.per_text(~white & ((data & 0xC0) != 0x80), begins),
        "n_symbols": common.per_text(SYMBOL[data], begins),
        "n_dup_lines": n_dup.astype(np.int64),
        "n_repeat_words": np.bincount(text[covered], minlength=len(texts)).astype(np.int64),
        "longest_repeat": top,
        "n_intervals": np.bincount(text[opens], minlength=len(texts)).astype(np.int64),
    }
    out["base_failed"] = (n_words < rules.least_words) | (100 * out["n_repeat_words"] > rules.percent_covered * n_words)
    out["kept"] = ~out["base_failed"] & (top <= rules.longest_words)
    return out


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, n_intervals long, base_failed boolean, kept boolean"


def _measured(batch_texts: list[bytes | None], rules: Rules) -> dict[str, np.ndarray]:
    parts = [measure(batch_texts[a:b], rules) for a, b in common.chunks(batch_texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def repetition(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measures and the verdict ``kept``. Narrow: nothing is shuffled."""
    source = common.pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = _measured(common.byte_texts(batch.column(1)), rules)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["id", *found])

    return source.mapInArrow(run, f"id {kind}, {MEASURES}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_measured(common.byte_texts(batch.column(at)), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
