"""Token ids of texts from their space-delimited pieces.

A text is cut only where the tokenizer always starts a new word, so ids of the pieces, put together, are the ids of the
text. Each piece goes to the tokenizers library once and is remembered, as words repeat far more often than texts do.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

#: Bytes of the pieces and words that a worker remembers; beyond them it starts afresh. A block of texts may add its own once.
REMEMBERED = 192 << 20
#: Bytes of a remembered entry besides its characters and its ids.
ENTRY_BYTES = 180
#: Longer texts are cut into segments of about this many characters.
SEGMENT_CHARS = 1 << 20
#: Texts handed over at once, in characters.
BLOCK_CHARS = 1 << 20

# White space in Unicode's or Python's sense other than the blank and the line feed.
_RARE_CODES = [9, *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_RARE_SPACE = re.compile("[" + "".join(map(chr, _RARE_CODES)) + "]")
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
# Runs that no tokenizer word spans: Latin letters (not the one whose lower case is two characters), one digit run, plain punctuation (no apostrophe), one line feed.
_RUNS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+| ?[0-9]+| ?[.,;:!?$%&#*()\"|+=@/_-]+|\n")
# Texts of nothing but such runs and single blanks or line feeds between them are cut into runs at once. The lower case of these
# letters is among them, too.
_RUN_CLASS = r"[A-Za-zÀ-ÖØ-öø-įı-ž0-9.,;:!?$%&#*()\"|+=@/_-]"
_PLAIN = re.compile(rf" ?{_RUN_CLASS}++(?:[ \n]{_RUN_CLASS}++)*+")
_BLANK_RUNS = re.compile(r"[a-zß-öø-įı-ž]+|[0-9]|[.,;:!?$%&#*()\"|+=@/_-]+")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")

# The steps before the merges, normalizer and pre-tokenizer, for which the cuts below hold, with and without kept spaces.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = {
    True: (None, {**_BYTES, "use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}, {**_BYTES, "use_regex": False}]},
    ),
}

_encoders: dict[tuple[str, bool, bool], PieceEncoder] = {}


def encoder(path: str, *, spaces_kept: bool, lengths_only: bool) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; tasks of one worker share what it remembers."""
    key = (path, spaces_kept, lengths_only)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, spaces_kept, lengths_only)
    return _encoders[key]


def segments(text: str, chars: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of a long text, cut before blanks that stand alone between other characters."""
    begin = 0
    while len(text) - begin > chars:
        cut = _LONE_BLANK.search(text, begin + chars)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


class _Learnt(dict):
    """Values by text; an unknown one is learned when it is asked for."""

    def __init__(self, learn: Callable[[str], int | bytes]):
        super().__init__()
        self._learn = learn

    def __missing__(self, text: str) -> int | bytes:
        value = self[text] = self._learn(text)
        return value


class PieceEncoder:
    """``spaces_kept``: a blank belongs to the word after it (byte-level vocabularies); else white space is dropped.

    Texts are cut only if the file's steps are the ones known for that; under any other vocabulary they are encoded whole. Values are token counts, or ids as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, spaces_kept: bool, lengths_only: bool, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self._known = (stated.get("normalizer"), stated.get("pre_tokenizer")) == _STEPS[spaces_kept] and stated["model"]["type"] == "BPE"
        # Letters as the byte-level step hands them to the merges; for single words that step is all that precedes them.
        step = ByteLevel(add_prefix_space=False, use_regex=False)
        codes = [32, *(c for c in range(0x250) if chr(c).isalpha())]
        self._byte_letters = {c: step.pre_tokenize_str(chr(c))[0][0] for c in codes}
        self._spaces_kept, self._lengths_only, self._remembered = spaces_kept, lengths_only, remembered
        self._pieces, self._words = _Learnt(self._piece), _Learnt(self._word)
        self._held = 0

    def __call__(self, texts: list[str | None]) -> list[int] | list[bytes]:
        """One value per text; null counts as empty."""
        values, block, chars = [], [], 0
        # Many small objects live on between blocks and none of them in cycles: collecting garbage would only walk them.
        collects = gc.isenabled()
        gc.disable()
        try:
            for text in texts:
                block.append(text or "")
                chars += len(block[-1])
                if chars >= BLOCK_CHARS:
                    values += self._block(block)
                    block, chars = [], 0
            return values + self._block(block)
        finally:
            if collects:
                gc.enable()

    def _block(self, texts: list[str]) -> list[int] | list[bytes]:
        if not self._known:
            ids = [x.ids for x in self._tokenizer.encode_batch(texts, add_special_tokens=False)]
            return list(map(len, ids)) if self._lengths_only else [array("I", x).tobytes() for x in ids]
        if self._held > self._remembered:
            self._pieces.clear()
            self._words.clear()
            self._held = 0
        out = []
        parts = [[self._parts(s) for s in segments(t)] for t in texts]
        words, pieces = self._words.__getitem__, self._pieces.__getitem__
        for own in parts:
            if self._lengths_only:
                out.append(sum(sum(map(words if plain else pieces, found)) for plain, found in own))
            else:
                out.append(b"".join(b"".join(map(words if plain else pieces, found)) for plain, found in own))
        return out

    def _parts(self, text: str) -> tuple[bool, list[str]]:
        """Runs of a plain text, each a word of its own to the tokenizer, or else pieces."""
        if not _PLAIN.fullmatch(text):
            return False, self._split(text)
        return True, _RUNS.findall(text) if self._spaces_kept else _BLANK_RUNS.findall(text.lower())

    def _split(self, text: str) -> list[str]:
        if not self._spaces_kept:
            return text.replace("\n", " ").split(" ")
        if "  " in text or " \n" in text or "\n " in text or _RARE_SPACE.search(text):
            first, *rest = _LONE_BLANK.split(text)
        else:
            first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _runs(self, piece: str) -> list[str]:
        """Runs that can be encoded apart, or the piece itself."""
        if _LETTERS.fullmatch(piece):
            return [piece] if self._spaces_kept else [piece.lower()]
        if "\n\n" in piece:
            return [piece]
        runs = _RUNS.findall(piece)
        if sum(map(len, runs)) != len(piece):
            return [piece]
        return runs if self._spaces_kept else [r.lower() for r in runs]

    def _remember(self, text: str, ids: list[int]) -> int | bytes:
        """The value of a text's ids; what the entry takes is counted."""
        value = len(ids) if self._lengths_only else array("I", ids).tobytes()
        self._held += 2 * len(text) + (0 if self._lengths_only else len(value)) + ENTRY_BYTES
        return value

    def _piece(self, piece: str) -> int | bytes:
        own = [self._words[r] for r in self._runs(piece)]
        value = own[0] if len(own) == 1 else sum(own) if self._lengths_only else b"".join(own)
        self._held += 2 * len(piece) + (0 if self._lengths_only else len(value)) + ENTRY_BYTES
        return value

    def _word(self, word: str) -> int | bytes:
        if _LETTERS.fullmatch(word):
            return self._remember(word, [t.id for t in self._model.tokenize(word.translate(self._byte_letters))])
        return self._remember(word, self._tokenizer.encode(word, add_special_tokens=False).ids)
