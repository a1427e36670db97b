"""Byte-level BPE ids by the ``tokenizers`` library, whose model gets each different word of a batch of texts once.

Texts of the characters in PLAIN are cut by Arrow as the library's pre-tokeniser would, with RE2, which has
no look-ahead: so a mark is first set before the last white space of a longer run. Arrow numbers the
different parts, many of them go to the library's model in one call, kept apart by a letter that it never
merges, and numpy lays their ids out in the order of the texts. Any other text goes through the library's
whole encoder. Nothing is kept from batch to batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Parts that go to the model in one call, and bytes of texts that are encoded together.
CALL, TOGETHER = 256, 6 << 20
#: Stands between parts; a text that has it is not plain.
MARK = "\0"
SPACES = " \\n\\t\\r"
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}\x{391}-\x{3A1}\x{3A3}-\x{3A9}\x{3B1}-\x{3C9}\x{410}-\x{44F}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FD5}\x{AC00}-\x{D7A3}"
SIGNS = r"!-/:-@\[-`{-~\x{A1}-\x{A9}\x{AB}-\x{B1}\x{B4}\x{B6}-\x{B8}\x{BB}\x{BF}\x{D7}\x{F7}\x{2010}-\x{2027}"
PLAIN = f"{SPACES}0-9{LETTERS}{SIGNS}"
#: The pre-tokeniser's pattern over plain texts.
PARTS = f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|[{SPACES}]+"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


class ByteBPE:
    """Whole texts to unsigned 32-bit ids, without special tokens of the end."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tok.model)  # without a pre-tokeniser
        self.letters = byte_letters()
        vocabulary = self.tok.get_vocab()
        inner = {c for t in vocabulary if len(t) > 1 for c in t}
        #: Letters of the bytes that no text has in UTF-8: one that stands in no longer token, so that no merge crosses it.
        self.bar = next(x for b in (0, *range(0xF8, 0x100)) if (x := self.letters[b]) in vocabulary and x not in inner)
        self.bar_id = vocabulary[self.bar]
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[^{PLAIN}]", *special])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different parts, one after the other, and where each begins (and the last one ends)."""
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(parts), CALL), len(parts)), pa.int32()), parts)
        out, ends = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        size = 0
        for joined in pc.binary_join(lists, MARK):
            written = joined.as_py().encode().decode("latin-1").translate(self.letters)  # MARK is byte 0, whose letter is given below
            ids = np.array(self.bare.encode_batch_fast([written.replace(self.letters[0], self.bar)])[0].ids, dtype="<u4")
            bars = np.flatnonzero(ids == self.bar_id)
            out.append(np.delete(ids, bars))
            ends.append(size + np.append(bars - np.arange(len(bars)), len(ids) - len(bars)))
            size += len(out[-1])
        return np.concatenate(out), np.concatenate(ends)

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts, one after the other; how many each has), until all texts are done, in order.

        Null and empty texts have none. About TOGETHER bytes of texts, or one longer text, are encoded at a time.
        """
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, side="right")))
            yield self._encode_some(texts.slice(at, upto - at))
            at = upto

    def _encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        if pc.any(runs := pc.match_substring_regex(plain, f"[{SPACES}]{{2}}")).as_py():
            plain = pc.if_else(runs, pc.replace_substring_regex(plain, f"([{SPACES}])([{SPACES}][^{SPACES}])", f"\\1{MARK}\\2"), plain)
        cut = pc.split_pattern(pc.replace_substring_regex(plain, PARTS, f"{MARK}\\0"), MARK)
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        flat, start = self._parts(coded.dictionary)
        n = np.diff(start)[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat(start[which] - ends[:-1], n)]
        counts = np.zeros(len(texts), dtype=np.int64)
        bounds = cut.offsets.to_numpy() - (cut.offsets[0].as_py() if len(cut) else 0)
        counts[~odd] = np.diff(ends[bounds])
        if odd.any():
            ends, at, out = np.cumsum(counts), 0, []
            for k in np.flatnonzero(odd):
                own = self._whole(texts[k].as_py())
                out += [ids[at : ends[k]], own]
                at, counts[k] = ends[k], len(own)
            ids = np.concatenate([*out, ids[at:]])
        return ids, counts

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for ids, counts in self.encode_array(pa.array(texts, pa.string())):
            yield from np.split(ids, np.cumsum(counts)[:-1])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return next(self.encode_all([text]))


_made: dict[str, ByteBPE] = {}


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts and how many each has, with one more id behind each text."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)).astype("<u4", copy=False), counts + 1


def byte_bpe(path: str) -> ByteBPE:
    """The worker's encoder for a vocabulary file."""
    if path not in _made:
        _made[path] = ByteBPE(path)
    return _made[path]
