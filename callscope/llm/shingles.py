"""Word shingles as sorted arrays of 64-bit hashes, and fast similarity sketches of them."""

from __future__ import annotations

import numpy as np

from .common import WordHashes, hash_words, mix64

#: ASCII upper case to lower case, and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EMPTY = np.empty(0, dtype=np.uint64)


#: Odd multipliers without additive relations, one per place in a window.
ODD = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive words, in order; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return EMPTY
    total = np.zeros(n, dtype=np.uint64)  # width is at most 64
    for i in range(width):
        total += words[i : i + n] * ODD[i]
    return mix64(total)


def shingle_set(text: bytes | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, ASCII letters lower-cased; with fewer words than
    the width the whole sequence is the one shingle; without words the set is empty."""
    words = hash_words((text or b"").translate(LOWER).split(), known)
    if not len(words):
        return EMPTY
    if len(words) < width:
        # the length takes part, so that a short sequence never equals a full shingle
        return windows(np.append(words, np.uint64(len(words))), len(words) + 1)
    return np.unique(windows(words, width))


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketch of every non-empty set: `bins` coordinates each.

    Round i < bins throws every element into a hashed bin; round bins + j puts every element into
    bin j. A value keeps its round in the top bits, so an earlier round always wins, and a set
    leaves as soon as its bins are full: about bins * ln(bins) throws, and never an empty bin.
    """
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = out.reshape(-1)
    open_sets = np.arange(len(sets))
    lengths = np.asarray([len(s) for s in sets], dtype=np.int64)
    values = np.concatenate(sets) if len(sets) else EMPTY
    owner = np.repeat(open_sets, lengths)
    for turn in range(2 * bins):
        hashed = mix64(values + np.uint64((0xD1B54A32D192ED03 * (turn + 1)) & (2**64 - 1)))
        if turn < bins:
            place = ((hashed >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
        else:
            place = np.full(len(values), turn - bins)
        kept = (np.uint64(turn) << np.uint64(52)) | (mix64(hashed) >> np.uint64(12))
        np.minimum.at(flat, owner * bins + place, kept)
        still = (out[open_sets] == np.iinfo(np.uint64).max).any(axis=1)
        if not still.any():
            break
        if not still.all():
            stays = np.zeros(len(sets), dtype=bool)
            stays[open_sets[still]] = True
            pick = stays[owner]
            values, owner, open_sets = values[pick], owner[pick], open_sets[still]
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` coordinates, distinct between bands."""
    n, bins = sketches.shape
    bands = bins // rows
    parts = sketches[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), (n, bands)).copy()
    for i in range(rows):
        key = mix64(key ^ parts[:, :, i] * ODD[i])
    return key
