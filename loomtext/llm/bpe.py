"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary's tokens form an Aho-Corasick trie; the longest token at a place is tried first. A token is kept if the merges would
leave a boundary between it and its predecessor: a table of split and merged pairs answers that (`fits`). Where no token fits, the
search steps back and marks the place as dead, so it visits each place a bounded number of times and yields exactly the tokens that
applying all merges in order yields.

Text is cut into words first, by the pattern in the tokenizer's file, after the file's own normalizer; each distinct word is encoded
once per batch of documents. Decoding gathers bytes from one blob of all tokens by the offsets of the ids.

Cases: a null text is encoded as an empty one: no ids and an empty decoded text; special tokens' strings in a text become their ids,
as in the library; texts of any length are encoded whole; repeated rows are encoded each, ties do not arise; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm.common import in_small_batches, sub_batches

BATCH_BYTES = 4 << 20
#: Distinct words that one worker remembers; beyond it, it starts anew.
WORDS_HELD = 150_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """A vocabulary with ordered merges. Tokens are strings of symbols; the end mark of a word belongs to its last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        self.end = end
        shut = self._shut
        self.ids = {shut(t): i for t, i in vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        rank, self.merged, self.parts = {}, {}, {}
        for a, b in pairs:
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((left, right), whole)
            if whole not in self.parts:
                self.parts[whole] = (left, right)
                rank[whole] = len(rank)
        # Merges are applied in this order; single symbols come before all.
        self.order = {i: rank.get(i, -1) + 1 for i in self.ids.values()}
        self.symbols = {i: t for t, i in self.ids.items()}
        self.size = {i: len(t) for t, i in self.ids.items()}
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.trie.add_word(t, i)
        self.trie.make_automaton()
        self.shorter: dict[int, int] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def _shut(self, token: str) -> str:
        """The token with its end mark folded into the last symbol: a letter from the private planes."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(0xF0000 + ord(body[-1]))
        return token

    def word(self, letters: str) -> str:
        return letters[:-1] + chr(0xF0000 + ord(letters[-1])) if self.end else letters

    def prefix(self, token: int) -> int:
        """The longest other token that starts this one; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            text = self.symbols[token]
            found = self.shorter[token] = next((self.ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.ids), -1)
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging in order keeps a boundary between two tokens. Answers are kept."""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) > WORDS_HELD:
                self.known.clear()
            found = self.known[left, right] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        """No pair across the boundary merges before its sides have grown."""
        order, parts, merged = self.order, self.parts, self.merged
        limit = len(order) + 1
        while True:
            whole = merged.get((left, right))
            if whole is not None and order[whole] < limit:
                return False
            # Undo the later of the two tokens; what it was made of met the other side before.
            if order[left] > order[right]:
                limit = order[left]
                left = parts[left][1]
            elif right in parts:
                limit = order[right] + 1
                right = parts[right][0]
            elif left in parts:
                limit = order[left]
                left = parts[left][1]
            else:
                return True

    def encode(self, letters: str) -> list[int]:
        """The ids of one word. Letters without a token are left out, and their neighbours meet."""
        return self._encode(self.word(letters))

    def _encode(self, word: str) -> list[int]:
        if not word:
            return []
        at = self._longest(word)
        out: list[int] = []
        alive, place, size = bytearray(b"\1") * (len(word) + 1), 0, len(word)
        token, fits = at[0], self.fits
        while place < size:
            if token is None:  # a letter that the vocabulary lacks
                return self._encode("".join(c for c in word if c in self.ids))
            last = out[-1] if out else -1
            while True:
                end = place + self.size[token]
                if alive[end] and (last < 0 or fits(last, token)):
                    out.append(token)
                    place = end
                    token = at[place] if place < size else None
                    break
                token = self.prefix(token)
                if token < 0:
                    alive[place] = 0
                    token = out.pop()
                    place -= self.size[token]
                    last = out[-1] if out else -1
                    token = self.prefix(token)
                    while token < 0:
                        alive[place] = 0
                        token = out.pop()
                        place -= self.size[token]
                        last = out[-1] if out else -1
                        token = self.prefix(token)
        return out

    def _longest(self, word: str) -> list:
        """The longest token that starts at each place of the word."""
        at: list = [None] * len(word)
        size = self.size
        for stop, token in self.trie.iter(word):
            at[stop - size[token] + 1] = token  # a later end overwrites an earlier one
        return at


class Offsets:
    """Byte strings laid end to end, gathered by their numbers, in units of one or more bytes."""

    def __init__(self, strings: list[bytes], unit=np.uint8):
        self.blob = np.frombuffer(b"".join(strings), unit)
        self.size = np.array([len(s) for s in strings], np.int64) // self.blob.itemsize
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def take(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return self.blob[:0]
        return self.blob[np.repeat(self.start[ids] - ends + sizes, sizes) + np.arange(ends[-1])]

    def gather(self, ids: np.ndarray) -> bytes:
        return self.take(ids).tobytes()


class Encoder:
    """The tokenizer of one file: normalizer, special tokens, word pattern and merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.tokenizer = spec["model"], Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        every = [names.get(i, "") for i in range(max(names) + 1)]
        self.decimal = Offsets([b"%d " % i for i in range(len(every))])
        if spec["decoder"] is None:  # the library joins such tokens with spaces
            self.decoded, self.joined = Offsets([t.encode() + b" " for t in every]), True
        else:
            back = {c: b for b, c in enumerate(self.letters)}
            self.decoded, self.joined = Offsets([bytes(back[c] for c in t) if i not in self.special.values() else t.encode() for i, t in enumerate(every)]), False
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.pattern = word_pattern(spec["pre_tokenizer"])
        self.memory, self.lettered = _Words(self, True), _Words(self, False)

    def words(self, text: str):
        """The text's words after the file's normalizer, and the memory that knows them.

        Texts of Latin letters take a short way: they are in composed form, lower case is per letter, and the pattern's classes
        are plain ranges. All others go through the library's own normalizer and pre-tokenizer.
        """
        if text.isascii() or not BEYOND_LATIN.search(text):
            return self.pattern.findall(text if self.tokenizer.normalizer is None else text.lower()), self.memory
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)], self.lettered

    def encode(self, text: str) -> np.ndarray:
        out = []
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(np.int32(self.special[piece]).tobytes())
            elif piece:
                words, memory = self.words(piece)
                out.extend(map(memory.__getitem__, words))
                memory.trim()
        return np.frombuffer(b"".join(out), np.int32)

    def ids_text(self, ids: np.ndarray) -> bytes:
        return self.decimal.gather(ids)[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; bytes that are no UTF-8 become replacement characters."""
        raw = self.decoded.gather(ids)
        return raw[:-1] if self.joined else raw.decode("utf-8", "replace").encode()


class _Words(dict):
    """word -> its ids as bytes, filled on demand. Raw words are spelled in byte letters first."""

    def __init__(self, encoder: Encoder, raw: bool):
        super().__init__()
        self.encoder, self.raw = encoder, raw

    def __missing__(self, word: str) -> bytes:
        e = self.encoder
        letters = word.encode().decode("latin-1").translate(e.table) if self.raw else word
        found = self[word] = np.array(e.merges.encode(letters), np.int32).tobytes()
        return found

    def trim(self, limit: int = WORDS_HELD) -> None:
        if len(self) > limit:
            self.clear()


#: Ranges below U+0250 of letters, digits and white space, and what lies beyond them. U+0130 has a lower case of two code points.
LETTERS, DIGITS, BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
BEYOND_LATIN = re.compile("[^\0-\u012f\u0131-\u024f]")


def word_pattern(pre):
    """The pattern of a pre-tokenizer for Latin texts: a Split that keeps its matches, or the byte-level default."""
    if pre["type"] == "ByteLevel":
        text = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    else:
        text = next(p["pattern"]["Regex"] for p in pre["pretokenizers"] if p["type"] == "Split")
    for name, plain in (("[\\p{L}]", f"[{LETTERS}]"), ("[\\p{N}]", f"[{DIGITS}]"), ("[^\\s\\p{L}\\p{N}]", f"[^{BLANKS}{LETTERS}{DIGITS}]"), ("\\p{L}", f"[{LETTERS}]"), ("\\p{N}", f"[{DIGITS}]"), ("\\S", f"[^{BLANKS}]"), ("\\s", f"[{BLANKS}]")):
        text = text.replace(name, plain)
    return re.compile(text)


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; with keep_text also ids (binary, int32) and decoded.

    `path` names a tokenizer's file that every executor can open; else each looks `name` up among the public tokenizers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tool = encoder(path or tokenizer_file(name))
        for whole in batches:
            for batch in sub_batches(whole, "text", BATCH_BYTES):
                rows = []
                for text in batch.column("text"):
                    ids = tool.encode(text.as_py() or "")
                    decoded = tool.decode(ids)
                    row = (len(ids), hashlib.sha256(tool.ids_text(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append(row + ((ids.tobytes(), decoded.decode()) if keep_text else ()))
                kinds = [pa.int64(), pa.string(), pa.string(), *([pa.binary(), pa.string()] if keep_text else [])]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_text else [])]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_text
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
