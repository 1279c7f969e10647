"""Splitting texts at white space and encoding each distinct chunk once.

The tokenizer files handled here drop white space and never join characters across it, so the ids of a text are the
ids of its chunks, one after the other. That holds for files whose pre-tokenizer keeps only matches without white
space, whose added tokens hold none, and whose normalizers look at no neighbour beyond it; ``check_file`` refuses others.

Where the file is of the kind of word_bpe (lower case, NFC, WORD_PATTERN), chunks are folded first, so that fewer are
distinct: ASCII letters become lower case, and an ASCII mark after a letter or digit begins a new chunk, as no match of the
pattern goes on from a letter or digit to a mark. Texts that may hold an added token stay as they are.
"""

from __future__ import annotations

import json
import os
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Chunks that a worker keeps, and chunks looked up in one go.
MAX_CHUNKS, GATHER = 300_000, 500_000
#: The pattern of the word_bpe file; letters of ASCII and Latin-1, which stay as they are under NFC.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, CAPITALS = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"
MARK = rf"([0-9{LETTERS}])([!-/:-@\[-`{{-~])"
#: Tasks are the parallelism; the library's threads would only fight over the same cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def read_file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def check_file(spec: dict) -> None:
    """Raise unless texts can be encoded chunk by chunk."""
    kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {"type": "none"}])}
    pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    dropped = any(p["type"] == "Split" and p.get("behavior") == "Removed" and p.get("invert") for p in pres)
    if spec["model"]["type"] != "BPE" or not kinds <= {"NFC", "Lowercase", "Replace", "none"} or not dropped:
        raise ValueError("only BPE files that drop white space can be encoded chunk by chunk")
    for t in spec.get("added_tokens", []):
        if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1:
            raise ValueError(f"added token {t['content']!r} needs its surroundings")


class Folding:
    """How texts become chunks for a file."""

    def __init__(self, spec: dict):
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pres = spec["pre_tokenizer"]["pretokenizers"]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.mark = os.path.commonprefix(self.added) if self.added else "\0"
        self.folds = {"NFC", "Lowercase"} <= set(kinds) and [p["type"] for p in pres] == ["Split", "ByteLevel"] and pres[0]["pattern"].get("Regex") == WORD_PATTERN and bool(self.mark)

    def __call__(self, texts: pa.Array) -> pa.Array:
        if not self.folds:
            return texts
        folded = pc.replace_substring_regex(pc.ascii_lower(texts), MARK, r"\1 \2")
        odd = pc.match_substring(texts, self.mark)
        return pc.if_else(odd, texts, folded) if pc.any(odd).as_py() else folded


def byte_letters() -> str:
    """What stands for each byte in byte-level files: itself if it is printable, else the next character after the bytes. The
    blank stays, as it stands between words here."""
    stay = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    letters = [chr(b if b in stay else next(other)) for b in range(256)]
    letters[0x20] = " "
    return "".join(letters)


class LibraryCodec:
    """Ids of chunks by the tokenizers library itself. Words of plain letters need no normalizing and no pattern, so many of
    them, one after the other and with their bytes' letters, are given to its model at once; the last token of each shows
    its end."""

    at_once, together = 100_000, 100

    def __init__(self, path: str):
        spec = read_file(path)
        check_file(spec)
        self.fold = Folding(spec)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.ends = None
        if self.fold.folds and (end := spec["model"].get("end_of_word_suffix")):
            self.plain = Tokenizer(self.tok.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters = byte_letters()
            self.ends = np.zeros(self.tok.get_vocab_size(), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(end)]] = True

    def ids_of(self, tokenizer: Tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, their numbers)."""
        word = np.zeros(len(chunks), bool)
        if self.ends is not None:
            mask = pc.match_substring_regex(chunks, f"^[{LETTERS}{CAPITALS}]+$")
            word = mask.to_numpy(zero_copy_only=False)
            words = pc.utf8_lower(chunks.filter(mask)).cast(pa.binary())
        lens = np.zeros(len(chunks), np.int64)
        own = self.ids_of(self.tok, chunks.take(pa.array(np.flatnonzero(~word))).to_pylist())
        lens[~word] = [len(x) for x in own]
        if not word.any():
            return np.concatenate([np.empty(0, np.int32), *own]), lens
        cuts = np.append(np.arange(0, len(words), self.together), len(words)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), b" ").to_pylist()
        of_words = np.concatenate(self.ids_of(self.plain, [charmap_decode(x, "strict", self.letters)[0] for x in lines]))
        ends = np.flatnonzero(self.ends[of_words]) + 1
        if len(ends) != len(words):
            raise ValueError("a word's end is not shown by its last token")
        lens[word] = np.diff(ends, prepend=0)
        out = np.empty(lens.sum(), np.int32)
        at_word = np.repeat(word, lens)
        out[at_word] = of_words
        out[~at_word] = np.concatenate([np.empty(0, np.int32), *own])
        return out, lens


class ChunkCache:
    """Distinct chunks seen by this process, up to a limit, and their ids as one flat array with offsets."""

    def __init__(self, codec, limit: int = MAX_CHUNKS):
        self.codec, self.limit = codec, limit
        self.known = pa.array([], pa.string())
        self.flat = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null counts as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        lists = pc.ascii_split_whitespace(self.codec.fold(texts))
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.dictionary_encode(lists.flatten())
        del lists
        number = pc.fill_null(pc.index_in(found.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = found.dictionary.take(pa.array(np.flatnonzero(number < 0)))
        flat, ends = self.flat, self.ends
        if len(fresh):
            parts = [self.codec(fresh.slice(k, self.codec.at_once)) for k in range(0, len(fresh), self.codec.at_once)]
            number[number < 0] = len(self.known) + np.arange(len(fresh))
            flat = np.concatenate([flat, *(ids for ids, _ in parts)])
            ends = np.concatenate([ends, ends[-1] + np.cumsum(np.concatenate([lens for _, lens in parts]))])
            if len(self.known) < self.limit:  # beyond it, chunks are known for this go only
                self.known = pa.concat_arrays([self.known, fresh.slice(0, self.limit - len(self.known))])
                self.ends = ends[: len(self.known) + 1].copy()
                self.flat = flat[: self.ends[-1]].copy()
        at = number[found.indices.to_numpy(zero_copy_only=False)]
        del found, fresh
        bounds = np.concatenate([[0], np.cumsum(counts)])
        known = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat))
        parts, per_text = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for k in range(0, len(at), GATHER):
            got = known.take(pa.array(at[k : k + GATHER]))
            parts.append(got.flatten().to_numpy(zero_copy_only=False))
            offsets = got.offsets.to_numpy()
            per_text.append(per_text[-1][-1] + offsets[1:] - offsets[0])
        total = np.concatenate(per_text)
        return np.concatenate(parts), total[bounds[1:]] - total[bounds[:-1]]
