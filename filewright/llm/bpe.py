"""Token ids of many texts at once, by byte-pair merges over all their distinct pieces in numpy.

Serves tokenizers with lower-casing, pieces of letters, single digits or other signs, and word ends;
what is not plain there, and any other tokenizer, goes through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import sys
import types

import numpy as np

from filewright.llm.text import mix, powers

END = "</w>"
# The settings of a tokenizer file for which pieces are found here.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[33:127] = OTHER
CLASS[[32, 9, 10, 13]] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LATIN = 0xC3  # first byte of the letters from U+00C0 to U+00FF; two of these are signs
KNOWN_PIECES = 1 << 18
SLOT_BITS = 20  # of the table in which pieces are looked up first
LONGEST = 64  # rounds of merging copy the piece, so longer ones go through the library
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
KEPT_POWERS = 1 << 20


def _byte_names() -> list[str]:
    """The printable sign that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {byte: chr(byte) for byte in plain}
    rest = [byte for byte in range(256) if byte not in names]
    return [names[b] if b in names else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Ids of texts for the tokenizer file at a path."""

    def __init__(self, path: str):
        self.path = path
        self._library = None
        self.powers = powers(BASE, 0), powers(INVERSE, 0)
        with open(path, encoding="utf-8") as file:
            entries = json.load(file)
        model = entries["model"]
        self.vocab = model["vocab"]
        self.size = 1 + max([*self.vocab.values(), *(token["id"] for token in entries["added_tokens"])])
        steps = (entries.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = (
            model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == END
            and not any(model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
            and entries.get("normalizer") == NORMALIZER
            and len(steps) == 2
            and steps[0].get("pattern") == {"Regex": SPLIT}
            and steps[1].get("type") == "ByteLevel"
            and not steps[1].get("add_prefix_space")
        )
        self._forget()
        if self.plain:
            names = _byte_names()
            self.inner = np.array([self.vocab[name] for name in names], np.int64)
            self.last = np.array([self.vocab[name + END] for name in names], np.int64)
            pairs = [merge if isinstance(merge, list) else merge.split(" ") for merge in model["merges"]]
            keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
            self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
            self._file(keys)

    def _forget(self) -> None:
        """Known pieces by their hash, with the begin and number of their ids in a list that grows."""
        self.known: dict[int, int] = {}
        self.begins = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        # Where the upper bits of a hash lead, the last piece met with such bits.
        self.slot_hashes = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_pieces = np.full(1 << SLOT_BITS, -1, np.int64)

    def _file(self, keys: np.ndarray) -> None:
        """A hash table of merges by rank: a pair is in one of few columns of its row."""
        self.keys = keys
        self.bits = 18
        rows = self._row(keys)
        order = np.argsort(rows, kind="stable")
        first = np.searchsorted(rows[order], rows[order])
        column = np.arange(len(keys)) - first
        self.table = np.full((int(column.max(initial=0)) + 1, 1 << self.bits), len(keys), np.int32)
        self.table[column, rows[order]] = order

    def _row(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number in each) of the UTF-8 texts between ``offsets``."""
        if not self.plain:
            texts = [data[s:e].tobytes().decode() for s, e in zip(offsets, offsets[1:])]
            made = [np.array(e.ids, np.uint32) for e in self.library().encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([*made, np.zeros(0, np.uint32)]), np.array([len(m) for m in made], np.int64)
        folded, starts, lengths, odd = pieces(offsets, data)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        hashes = self._hashes(folded, starts, lengths, odd)
        known = self._known(hashes, folded, data, starts, lengths, odd)
        counts = self.counts[known]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.begins[known] - (ends - counts), counts)]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(starts, offsets)])

    def _hashes(self, folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """A hash of each piece: its bytes times powers, as a difference of sums from the begin of the data."""
        size = len(folded)
        if len(self.powers[0]) < size <= KEPT_POWERS:
            self.powers = powers(BASE, size), powers(INVERSE, size)
        ahead, back = self.powers if size <= KEPT_POWERS else (powers(BASE, size), powers(INVERSE, size))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((folded + np.uint64(1)) * ahead[:size], out=sums[1:])
        own = (sums[starts + lengths] - sums[starts]) * back[starts]
        return mix(own * np.uint64(BASE) ^ (lengths.astype(np.uint64) << np.uint64(33)) ^ (odd.astype(np.uint64) << np.uint64(63)))

    def _known(self, hashes, folded, data, starts, lengths, odd) -> np.ndarray:
        """The number of each piece; those that are not in their slot are looked up, or learned, once each."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = np.where(self.slot_hashes[slots] == hashes, self.slot_pieces[slots], -1)
        missed = np.flatnonzero(known < 0)
        if len(missed):
            distinct, first, codes = np.unique(hashes[missed], return_index=True, return_inverse=True)
            found = self._learn(distinct, missed[first], folded, data, starts, lengths, odd)
            known[missed] = found[codes]
            slots = slots[missed[first]]
            self.slot_hashes[slots], self.slot_pieces[slots] = distinct, found
        return known

    def _learn(self, distinct, first, folded, data, starts, lengths, odd) -> np.ndarray:
        """The numbers of these pieces, whose ids are known then."""
        found = np.array([self.known.get(value, -1) for value in distinct.tolist()], np.int64)
        fresh = found < 0
        if not fresh.any():
            return found
        hashes, first = distinct[fresh], first[fresh]
        usual = ~odd[first] & (lengths[first] <= LONGEST)
        counts = np.zeros(len(first), np.int64)
        ids, counts[usual] = self._merged(folded, starts[first[usual]], lengths[first[usual]])
        parts = [ids]
        for k in np.flatnonzero(~usual):
            raw = data[starts[first[k]] : starts[first[k]] + lengths[first[k]]].tobytes().decode()
            made = self.library().encode(raw, add_special_tokens=False).ids
            counts[k] = len(made)
            parts.append(np.array(made, np.uint32))
        # Lists in the order in which they were made: the usual new ones, then the others.
        order = np.concatenate((np.flatnonzero(usual), np.flatnonzero(~usual)))
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.arange(len(self.counts), len(self.counts) + len(order))
        found[fresh] = numbers
        self.known.update(zip(hashes.tolist(), numbers.tolist()))
        counts = counts[order]
        self.begins = np.append(self.begins, len(self.ids) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.ids = np.concatenate((self.ids, *parts))
        return found

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or a number above all."""
        key = left << 32 | right
        row = self._row(key)
        found = np.full(len(key), len(self.keys))
        known = np.append(self.keys, -1)
        for column in self.table:
            rank = column[row]
            found = np.where(known[rank] == key, rank, found)
        return found

    def _merged(self, folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece): every round does the first merge of least rank in every piece that has one."""
        total = int(lengths.sum())
        out_counts = np.zeros(len(starts), np.int64)
        if not total:
            return np.zeros(0, np.uint32), out_counts
        begin = np.cumsum(lengths) - lengths
        within = np.arange(total) - np.repeat(begin, lengths)
        signs = folded[np.repeat(starts, lengths) + within]
        ids = self.inner[signs]
        ends = begin + lengths - 1
        ids[ends] = self.last[signs[ends]]
        none = len(self.keys)
        rank = np.full(total, none)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[ends] = none
        piece = np.arange(len(starts))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(piece):
            best = np.minimum.reduceat(rank * total + np.arange(len(ids)), begin)  # least rank, first place
            active = best < none * total
            if not active.all():
                mask = np.repeat(active, lengths)
                done.append((piece[~active], lengths[~active], ids[~mask]))
                moved = np.cumsum(mask) - 1
                best = best[active]
                at = moved[best % total]
                ids, rank = ids[mask], rank[mask]
                piece, lengths = piece[active], lengths[active]
                begin = np.cumsum(lengths) - lengths
                if not len(piece):
                    break
            else:
                at = best % total
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one sign goes in each piece before
            rank[np.flatnonzero(~keep) - 1] = rank[~keep]  # the end of a piece stays one
            ids, rank = ids[keep], rank[keep]
            lengths = lengths - 1
            begin = begin - np.arange(len(begin))
            last = begin + lengths - 1
            inner = at[at < last]
            rank[inner] = self._rank(ids[inner], ids[inner + 1])
            rank[last] = none
            before = at[at > begin] - 1
            rank[before] = self._rank(ids[before], ids[before + 1])
        pieces_, counts, made = (np.concatenate(x) for x in zip(*done))
        out_counts[pieces_] = counts
        begins = np.cumsum(counts) - counts
        order = np.argsort(pieces_)
        counts, begins = counts[order], begins[order]
        take = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return made[np.repeat(begins, counts) + take].astype(np.uint32), out_counts


def encoder(path: str) -> Encoder:
    """The encoder of a worker process for a tokenizer file, with the pieces that earlier tasks have met.

    Code of this package comes to workers with each task, so what outlives a task is kept among the modules.
    """
    kept = sys.modules.setdefault("filewright_encoders", types.ModuleType("filewright_encoders")).__dict__
    name = f"{path} {os.stat(path).st_mtime_ns}"
    if name not in kept:
        kept[name] = Encoder(path)
    return kept[name]


def pieces(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, start and length of each piece, whether it is odd); a run between spaces with unusual bytes is one odd piece."""
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return data, none, none, none.astype(bool)
    kind = CLASS[data]
    folded = LOWER[data]
    second = np.zeros(size, bool)
    second[1:] = (data[:-1] == LATIN) & (data[1:] >= 0x80)
    lead = np.zeros(size, bool)
    lead[:-1] = second[1:]
    signs = second & ((data == 0x97) | (data == 0xB7))
    letters = second & ~signs
    kind[letters] = LETTER
    kind[np.flatnonzero(letters) - 1] = LETTER
    upper = letters & (data < 0x9F)
    folded[upper] += 32
    kind[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))] = ODD  # may begin a special token
    first = np.zeros(size + 1, bool)
    first[offsets] = True
    first = first[:size]
    before = np.append(SPACE, kind[:-1])
    spaced = first | (before == SPACE)
    chunk = (kind != SPACE) & spaced
    run = np.cumsum(chunk | (kind == SPACE))
    odd_run = np.zeros(int(run[-1]) + 1, bool)
    odd_run[run[kind == ODD]] = True
    odd = odd_run[run] & (kind != SPACE)
    begins = (kind != SPACE) & (spaced | (kind != before) | (kind == DIGIT))
    quotes = np.flatnonzero((data == ord("'")) & ((before != OTHER) | first) & ~odd)
    if len(quotes):
        edge = np.append(offsets[1:], size)[np.searchsorted(offsets, quotes, "right") - 1]
        ahead = np.append(folded, [0, 0])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        reach = np.where(np.isin(one, list(SHORT)), 1, 0)
        for pair in LONG:
            reach = np.where((one == pair[0]) & (two == pair[1]), 2, reach)
        reach = np.where(quotes + reach < edge, reach, np.where((reach == 2) & np.isin(one, list(SHORT)) & (quotes + 1 < edge), 1, 0))
        hit = reach > 0
        begins[quotes[hit] + 1] = False
        after = (quotes + reach + 1)[hit]
        after = after[after < np.minimum(edge[hit], size)]
        begins[after[kind[after] == LETTER]] = True
    begins = np.where(odd, chunk, begins)
    starts = np.flatnonzero(begins)
    stop = np.append(starts[1:], size)
    # A piece ends where the next begins, or at the space before that.
    spaces = np.append(np.flatnonzero(kind == SPACE), size)
    lengths = np.minimum(stop, spaces[np.searchsorted(spaces, starts)]) - starts
    return np.where(odd, data, folded), starts, lengths, odd[starts]
