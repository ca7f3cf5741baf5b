"""Substring deduplication by prefix-partitioned suffix trees over words.

A window is 35 words of one document; a window goes if its words also start anywhere else. ``_repeats`` gathers the pieces of text
that may hold such windows, those with one anchor in one bin. There, the suffixes that begin windows are split by prefixes of one
word; a prefix that more than ``GROUP`` suffixes share is made longer, word by word, and small ones are put together, so each
group fits in memory. A group's subtree is built level by level: each round reads the next words of the suffixes that still
share a node (elastic range) and leaves the sorted leaves and, between neighbours, the depth at which they part. Internal nodes of
35 words or deeper are the repeats.

Nulls and empty texts have no words. Null ids and repeated rows are documents of their own, so repeated rows remove each other's
windows. Texts under 35 words keep everything; long texts are taken whole. An empty table gives an empty result. Other columns are not
looked at. Subtrees number the words by 64-bit hashes keyed anew for each comparison, so that nobody can have made up words that collide.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import documents
from ._repeats import Finder, Pieces, Tokens, covered
from ._words import NOT_WHITE, new_seed, shingle_hashes, split_words

#: Words of a window, and of the grams whose least one anchors it.
WIDTH, GRAM = 35, 5
#: Suffixes of a group, and words read in a round.
GROUP, ROUND = 200_000, 5


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    w = split_words(data, offsets, NOT_WHITE, lower=False)
    return Tokens(shingle_hashes(w.hash, GRAM), w.left(), w.row, w.start, w.end)


def prefix_groups(words: np.ndarray, suffixes: np.ndarray, most: int, width: int) -> list[np.ndarray]:
    """Suffixes in groups of about ``most`` at most, those of one prefix together. ``words``: numbers of words.

    Suffixes alike in all ``width`` words stay together: they are one window, and are not taken apart further.
    """
    out: list[np.ndarray] = []
    todo = [(suffixes, 0)]
    while todo:
        mine, depth = todo.pop()
        if len(mine) <= most or depth == width:
            out.append(mine)
            continue
        key = words[mine + depth]
        by = np.argsort(key, kind="stable")
        mine, key = mine[by], key[by]
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        begin = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > most:
                todo.append((mine[a:b], depth + 1))
                if a > begin:
                    out.append(mine[begin:a])
                begin = b
            elif b - begin > most:
                out.append(mine[begin:a])
                begin = a
        if begin < len(mine):
            out.append(mine[begin:])
    return out


def subtree(words: np.ndarray, suffixes: np.ndarray, width: int, step: int = ROUND) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in order, and the words that each has in common with the leaf before it (``width`` at most)."""
    leaves = suffixes.copy()
    parts = np.full(len(leaves), width, np.int64)
    parts[:1] = 0
    active = np.arange(len(leaves))  # places whose node is shared with another leaf
    node = np.zeros(len(leaves), np.int64)
    depth = 0
    while len(active) and depth < width:
        reach = min(step, width - depth)
        columns = [words[leaves[active] + depth + k] for k in range(reach)]
        by = np.lexsort((*reversed(columns), node[active]))
        leaves[active] = leaves[active][by]
        columns = [c[by] for c in columns]
        inside = np.append(False, node[active][1:] == node[active][:-1])
        differs = np.zeros(len(active), dtype=bool)
        for k, c in enumerate(columns):
            new = np.append(False, c[1:] != c[:-1]) & inside & ~differs
            parts[active[new]] = depth + k
            differs |= new
        # Nodes of one leaf are finished.
        begin = ~inside | differs
        number = np.cumsum(begin) - 1
        shared = np.bincount(number)[number] > 1
        node[active] = active[begin][number]
        active = active[shared]
        depth += reach
    return leaves, parts


def deep_nodes(parts: np.ndarray, width: int) -> np.ndarray:
    """For each leaf, the number of the node of depth ``width`` that it is under; leaves alone have nodes of their own."""
    return np.cumsum(parts < width) - 1 if len(parts) else parts


def resolve(p: Pieces, width: int = WIDTH, most: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the windows that start anywhere else too. Pieces come by anchor, so runs of whole anchors are taken at a time."""
    out = []
    ends, tokens = np.cumsum(p.size), np.cumsum(p.tokens)
    new = np.append(np.flatnonzero(np.append(True, p.anchor[1:] != p.anchor[:-1])), len(p.anchor))
    i = 0
    while i < len(new) - 1:
        a = int(new[i])
        limit = tokens[a] - p.tokens[a] + 4 * most
        # Whole anchors, as many as fit.
        j = max(i + 1, int(np.searchsorted(tokens[new[1:] - 1], limit, side="right")))
        b = int(new[min(j, len(new) - 1)])
        i = j
        offsets = np.append(ends[a] - p.size[a], ends[a:b])
        data = p.bytes_of(a, b)
        w = split_words(data, offsets - offsets[0], NOT_WHITE, lower=False, seed=new_seed())
        _, words = np.unique(w.hash, return_inverse=True)
        words = words.astype(np.int32)
        suffixes = np.flatnonzero(w.left() >= width)
        goes = np.zeros(len(w), dtype=bool)
        for group in prefix_groups(words, suffixes, most, width):
            leaves, parts = subtree(words, group, width)
            node = deep_nodes(parts, width)
            goes[leaves[np.bincount(node)[node] > 1]] = True
        piece = w.row
        start = goes.copy()
        start[1:] &= ~goes[:-1] | (piece[1:] != piece[:-1])
        stop = goes.copy()
        stop[:-1] &= ~goes[1:] | (piece[1:] != piece[:-1])
        first, last = np.flatnonzero(start), np.flatnonzero(stop)
        of = piece[first]
        base = p.at[a + of] - w.first[of]
        out.append((p.address[a + of], base + first, base + last + width))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FINDER = Finder(word_tokens, GRAM, WIDTH, False, resolve)


def _kept(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    words = text.split()
    if not len(first):
        return len(words), 0, b" ".join(words)
    gone = covered(len(words), first, end)
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def _finish(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple[int, int, str]:
    n, removed, kept = _kept(text, first, end)
    return n, removed, hashlib.sha256(kept).hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the words that are left, joined by spaces."""
    return FINDER.removed(docs, id_col, text_col, lambda t, a, b: (_kept(t, a, b)[2].decode(),), "text string")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FINDER.removed(documents(spark, sf_dir), "doc_id", "text", _finish, "n_words bigint, n_removed bigint, kept_sha256 string")


#: The same by SQL: all windows are grouped by their words.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM g) WHERE c > 1),
x AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r)),
k AS (SELECT doc_id, list(p) AS ps FROM x GROUP BY doc_id),
u AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
j AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN x ON u.doc_id = x.doc_id AND u.p = x.p GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN j USING (doc_id)
"""
