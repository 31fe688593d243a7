"""Tokenisation with the tokenizers library, for use inside tasks.

Most words of a corpus come again and again, so ids are remembered per word.  A batch of texts is split and numbered
by Arrow; only the distinct words of a batch are looked up, only unknown ones are encoded, and the texts are one
gather from the remembered ids.  This is exact for a pre-tokeniser that never joins characters across white space,
which :class:`WordTokenizer` verifies on the tokenizer's own output when it is built; a text with white space other
than ASCII's is encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space and separators beyond ASCII space and U+0009 to U+000D.
_ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that may not be put into lower case beforehand: letters from U+0250 on, or I with a dot, do not all map one to
#: one, and names of special tokens are read by exact case.
_AS_IS = r"[\x{130}\x{250}-\x{10ffff}]|<\|"
_LETTERS = r"a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{24f}"
#: Lower-case letters below U+0250 are unchanged by NFC and form one pre-token.
_PLAIN = rf"^[{_LETTERS}]+$"
#: One mark after a letter or digit, at the end of a word, is a pre-token of its own.
_MARK = rf"([{_LETTERS}0-9])([.,;:!?])([\t-\r ]|$)"
_PROBE = "  Ab,cd\t'll x1<y>été \n\n!!? don't_a 12,5\r\nzz"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spelling() -> dict[int, str]:
    """How byte-level models write the letters from U+0080 to U+024F: a letter for each byte of their UTF-8 form,
    printable bytes by themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0x80, 0x250)}


class WordTokenizer:
    """``encode_array(texts)`` gives the ids of all texts behind one another and how many each has, as the tokenizer
    does without special tokens.

    Words are numbered; their ids lie in one flat array.  Beyond ``remember`` words, or 32 MB of them, the less used
    half and all very long ones are forgotten, and texts are taken ``chunk_chars`` bytes at a time, so memory is bounded.
    """

    def __init__(self, path: str, remember: int = 250_000, chunk_chars: int = 1 << 22):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.units = Tokenizer.from_file(path)
        self.units.normalizer, self.units.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.remember, self.chunk_chars, self.letters = remember, chunk_chars, _spelling()
        self._start()
        self.by_word = self._whole(_PROBE) == [i for w in _PROBE.split() for i in self._whole(w)]
        # The last token of a word carries the model's suffix, which tells where words end in a run of them.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())] if suffix else []
        self.last = np.array([n.endswith(suffix) for n in names], bool) if suffix else None
        probes = ["hello", "zz", "the", "qxzqx", ",", "internationalisation", "\xe9t\xe9", "stra\xdfe", "\xf1and\xfa", "a", "?"]
        marked = [("Hello,", "hello ,"), ("x1!", "x1 !"), ("\xc9T\xc9?", "\xe9t\xe9 ?")]
        self.plain = self.by_word and suffix is not None
        self.plain = self.plain and all(map(np.array_equal, self._run(probes), self._flat([self._whole(w) for w in probes])))
        self.plain = self.plain and all(self._whole(a) == self._whole(b) for a, b in marked)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids behind one another, and how many each list has."""
        lens = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    def _run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_flat` for plain words, from one call on all of them."""
        run = " ".join(words)
        if not run.isascii():
            run = run.translate(self.letters)
        ids = np.asarray(self.units.encode_batch_fast([run], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words numbered ``at``, and how many each has."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        return self.ids[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)], lens

    def _start(self) -> None:
        # The empty word is known from the start: splitting gives one before and after a text's outer white space.
        self.words = pa.array([""])
        self.ids, self.starts, self.lens, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.ids = np.concatenate([self.ids, ids])

    def _forget(self) -> None:
        """Keep the more used half of the words, none of over 64 bytes."""
        short = np.flatnonzero(pc.less_equal(pc.binary_length(self.words), 64))[1:]
        kept = short[np.argsort(-self.uses[short], kind="stable")[: self.remember // 2]]
        words, uses, (ids, lens) = self.words.take(pa.array(kept)), self.uses[kept] // 2, self._gather(kept)
        self._start()
        self._learn(words, ids, lens)
        self.uses[1:] = uses

    def _know(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct ``words``; unknown ones are encoded."""
        number = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = number < 0
        if len(self.words) + np.count_nonzero(unknown) > self.remember or self.words.nbytes > 32 << 20:
            self._forget()
            number = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            unknown = number < 0
        at = np.flatnonzero(unknown)
        if not len(at):
            return number
        new = words.filter(pa.array(unknown))
        plain = pc.and_(pc.match_substring_regex(new, _PLAIN), pc.equal(new, pc.utf8_lower(new)))
        plain = pc.or_(plain, pc.is_in(new, pa.array(list(".,;:!?")))).to_numpy(zero_copy_only=False) & self.plain
        ascii_ = pc.string_is_ascii(new).to_numpy(zero_copy_only=False)
        whole = lambda some: self._flat([e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
        for kind, encode in ((plain & ascii_, self._run), (plain & ~ascii_, self._run), (~plain, whole)):
            if kind.any():
                some = new.filter(pa.array(kind))
                number[at[kind]] = len(self.words) + np.arange(len(some))
                self._learn(some, *encode(some.to_pylist()))
        return number

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        number = self._know(coded.dictionary)
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        self.uses[number] += np.bincount(coded.indices, minlength=len(number))
        ids, lens = self._gather(at)
        ends = np.concatenate([[0], np.cumsum(lens)])
        stops = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return ids, np.diff(ends[stops])

    def _texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_array`, for texts that are split at ASCII white space, chunk by chunk."""
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        ids, lens, a = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, size[a] + self.chunk_chars, "right")) - 1)
            for out, part in zip((ids, lens), self._chunk(texts.slice(a, b - a))):
                out.append(part)
            a = b
        return np.concatenate(ids), np.concatenate(lens)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` behind one another, and the number of each; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE) if self.by_word else pa.array(np.ones(len(texts), bool))
        as_is = pc.match_substring_regex(texts, _AS_IS) if self.plain else pa.array(np.ones(len(texts), bool))
        low = pc.and_not(pc.invert(odd), as_is)
        parts = []
        for kind, encode in ((low, self._lowered), (pc.and_not(as_is, odd), self._texts), (odd, self._one_by_one)):
            if len(some := texts.filter(kind)):
                parts.append((np.flatnonzero(kind), *encode(some)))
        if len(parts) == 1:
            return parts[0][1:]
        lens, starts, held = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        for at, ids, n in parts:
            lens[at], starts[at] = n, held + np.cumsum(n) - n
            held += len(ids)
        ids, ends = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint32)]), np.cumsum(lens)
        return ids[np.repeat(starts - (ends - lens), lens) + np.arange(len(ids))], lens

    def _lowered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lower case, and marks apart from their words, so that fewer distinct words are left."""
        return self._texts(pc.replace_substring_regex(pc.utf8_lower(texts), _MARK, r"\1 \2\3"))

    def _one_by_one(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([self._whole(t) for t in texts.to_pylist()])

    def encode(self, text: str) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[0].tolist()


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for ``path``; Python workers are reused, and so are the words they remember."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
