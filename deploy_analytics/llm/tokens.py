"""Token ids by the tokenizers library, each distinct piece of text encoded once per worker.

Both tokenizers here never merge across certain cuts (white space, or the matches
of a pattern), so a text's ids are the ids of its parts one after the other. Parts
repeat much; a worker keeps the ids of those it met, as bytes, and a text's ids
are one join.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata

TOGETHER = 200  #: texts whose new parts are encoded together
MEMO = 400_000  #: parts of the current generation; the one before it is kept too


def limit_threads() -> None:
    """Spark already runs a task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def ids_bytes(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class Memo(dict):
    """part -> its ids as little-endian unsigned 32-bit bytes; parts not met for two generations are forgotten.

    encode takes a list of parts. A part may be made of others by ``cut``, which gives
    its pieces or None; the pieces are then remembered too.
    """

    def __init__(self, encode, cut=None, cap: int = MEMO):
        super().__init__()
        self.encode, self.cut, self.cap, self.old = encode, cut or (lambda part: None), cap, {}
        self.special: dict[str, bytes] = {}  # strings that are tokens by themselves, with their ids

    def __missing__(self, part):
        self.learn({part})
        return dict.__getitem__(self, part)

    def learn(self, parts: set) -> None:
        """Remember the ids of parts, new ones encoded together."""
        missing = [p for p in parts if p not in self]
        if len(self) + len(missing) > self.cap:
            self.old = dict(self)
            self.clear()
        whole, made = set(), {}
        for part in missing:
            if (found := self.old.get(part)) is not None:
                self[part] = found
            elif (pieces := self.cut(part)) is not None:
                made[part] = pieces
            else:
                whole.add(part)
        for piece in {p for pieces in made.values() for p in pieces if p not in self}:
            if (found := self.old.get(piece)) is not None:
                self[piece] = found
            else:
                whole.add(piece)
        fresh = list(whole)
        self.update(zip(fresh, self.encode(fresh), strict=True) if fresh else ())
        for part, pieces in made.items():
            self[part] = b"".join(dict.__getitem__(self, p) for p in pieces)


_kept: dict[tuple, Memo] = {}


SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  #: ASCII signs but the apostrophe, which contractions use


def _without_signs(part: bytes) -> tuple[bytes, bytes] | None:
    """A word and the signs behind it: no token spans a letter or digit and a sign, and signs in a row are one part."""
    text = part.decode()
    word = text.rstrip(SIGNS)
    if not word or len(word) == len(text) or not (_latin_letter(word[-1]) or "0" <= word[-1] <= "9"):
        return None
    return word.encode(), text[len(word) :].encode()


def _latin_letter(c: str) -> bool:
    """Whether c is a Latin letter and normalizing it, which lower-cases, ends in a letter too: that of U+0130 ends in a combining dot."""
    return c < "\u0250" and c.isalpha() and unicodedata.normalize("NFC", c.lower())[-1].isalpha()


def _plain_word(text: str) -> bool:
    """Lower-case Latin letters alone: normalizing and splitting leave them as they are."""
    return text.isalpha() and max(text) < "\u0250" and text == text.lower()


def byte_characters() -> list[str]:
    """The character of each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def word_memo(path: str) -> Memo:
    """For a tokenizer that drops white space: parts are runs of other bytes, in lower case A-Z."""
    if ("word", path) not in _kept:
        limit_threads()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = {t.content: ids_bytes([i]) for i, t in tokenizer.get_added_tokens_decoder().items()}
        tokenizer.encode_special_tokens = True  # in parts, which are lower-cased, their strings are ordinary text
        character, model = byte_characters(), tokenizer.model

        def encode(parts: list[bytes]) -> list[bytes]:
            out, hard = [b""] * len(parts), []
            for i, text in enumerate(p.decode() for p in parts):
                if _plain_word(text):
                    spelt = text if text.isascii() else "".join(character[x] for x in parts[i])
                    out[i] = ids_bytes(t.id for t in model.tokenize(spelt))
                else:
                    hard.append(i)
            for i, found in zip(hard, tokenizer.encode_batch_fast([parts[i].decode() for i in hard], add_special_tokens=False), strict=True):
                out[i] = ids_bytes(found.ids)
            return out

        _kept["word", path] = Memo(encode, _without_signs)
        _kept["word", path].special = special
    return _kept["word", path]


def word_ids(texts: list[str], memo: Memo) -> list[bytes]:
    """Ids of whole texts, as of a plain call of the tokenizer.

    It looks for the strings of special tokens in the text as it is and splits it
    there; what is left it lower-cases, so lower-casing A-Z first changes nothing.
    """
    out, marks = [], re.compile("(" + "|".join(map(re.escape, memo.special)) + ")") if memo.special else None
    for at in range(0, len(texts), TOGETHER):
        split: list[list] = []
        for t in texts[at : at + TOGETHER]:
            pieces = marks.split(t) if marks and any(m in t for m in memo.special) else [t]
            split.append([memo.special[s] if i % 2 else s.encode().lower().split() for i, s in enumerate(pieces)])
        memo.learn({p for pieces in split for words in pieces[::2] for p in words})
        out += [b"".join(b"".join(map(memo.__getitem__, x)) if isinstance(x, list) else x for x in pieces) for pieces in split]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
