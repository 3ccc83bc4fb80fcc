"""Public byte-pair vocabularies (``.json`` of the tokenizers library) as plain Python tables."""

from __future__ import annotations

import json
import unicodedata

import regex

#: code points from which on unassigned ones are worth looking for
RARE = regex.compile(r"[\u0530-\U0010FFFF]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Model:
    """Vocabulary, merge ranks, special strings and the pre-tokenising rules of a file."""

    #: fixed value: the word pattern of a ByteLevel pre-tokeniser that has none of its own
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks: dict[tuple[str, str], int] = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.letters = byte_letters()
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        steps = (spec["normalizer"] or {"normalizers": []}).get("normalizers", [spec["normalizer"]])
        kinds = [s["type"] for s in steps]
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"unknown normalisers: {kinds}")
        self._nfc, self._lower = "NFC" in kinds, "Lowercase" in kinds
        self._pattern = regex.compile(self._words(spec["pre_tokenizer"]))
        #: whether words may hold the white space before them
        self.spaced = bool(self._pattern.search(" x").group() == " x")
        self._decoder = spec["decoder"]
        self._bytes = {c: b for b, c in enumerate(self.letters)}
        self._source = source
        self._library = None

    def _words(self, pre: dict) -> str:
        # white space is the Unicode property; the regex module's \s has four controls more
        for step in pre.get("pretokenizers", [pre]):
            if step["type"] == "Split":
                if step["behavior"] != "Removed" or not step["invert"]:
                    raise ValueError("only splits that keep the matches are supported")
                return step["pattern"]["Regex"]
        return self.BYTE_LEVEL

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """(piece, is special): special strings match in the raw text, everything else lies between them."""
        if not self._special or "<|" not in text and not self._special.search(text):
            return [(text, False)]
        return [(p, p in self.special) for p in self._special.split(text) if p]

    def normal(self, text: str) -> str | None:
        """The normalised text; None where it has code points that this Python does not know:
        whether they are letters is the library's to say, as Unicode versions differ."""
        if not text.isascii():
            if RARE.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
                return None
            if self._nfc and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if self._lower:
                text = text.replace("Σ", "σ")  # letter by letter: a final sigma is not special
        return text.lower() if self._lower else text

    def words(self, text: str) -> list[str]:
        """The words of ordinary text, normalised."""
        normal = self.normal(text)
        return self._newer(text) if normal is None else self._pattern.findall(normal)

    def split(self, normal: str) -> list[str]:
        """The words of normalised text."""
        return self._pattern.findall(normal)

    def _newer(self, text: str) -> list[str]:
        """Words of a text with code points that only the library knows."""
        from tokenizers import Tokenizer
        if self._library is None:
            self._library = Tokenizer.from_str(self._source)
        lib = self._library
        if lib.normalizer:
            text = lib.normalizer.normalize_str(text)
        return [bytes(self._bytes[c] for c in w).decode() for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    def decode(self, ids: list[int]) -> str:
        """Ids to text; ids outside the vocabulary are skipped, as the library does."""
        try:
            parts = list(map(self.tokens.__getitem__, ids))
        except KeyError:
            parts = [self.tokens[i] for i in ids if i in self.tokens]
        if self._decoder is None:
            return " ".join(parts)
        table, out = self._bytes, bytearray()
        for part in parts:
            try:
                out += bytes([table[c] for c in part])
            except KeyError:
                out += part.encode("utf-8")
        return out.decode("utf-8", errors="replace")
