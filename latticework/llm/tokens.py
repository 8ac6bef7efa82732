"""Token ids by the tokenizers library, with a bounded cache of the parts of texts that recur."""

from __future__ import annotations

import os
from array import array

from . import common

#: Parts kept by a Python worker. A full cache takes no more parts, since those seen first are the common ones; after
#: four times as many misses, say in other languages, it starts anew.
MOST_PARTS = 800_000


class Encoder:
    """Encodes whole texts to ids as little-endian unsigned 32-bit integers.

    A text is cut before each single space or line end that stands between two other characters. Neither vocabulary has a
    token or a rule that reaches across such a place, so the parts' ids, joined, are the text's ids. Texts with longer runs
    of white space, where that does not hold, are given to the library whole; a vocabulary that drops white space (``loose``)
    needs no such care.
    """

    def __init__(self, path: str, most: int = MOST_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        joined, apart = self.ids(["a \n b"])[0], self.ids(["a", "b"])
        self.loose = joined == b"".join(apart)
        #: ids by part; False for a part of white space alone, which may belong to a longer run
        self.parts: dict[str, bytes | bool] = {"": b""} if self.loose else {}
        self.missed, self.most = 0, most
        self.marks = dict(zip(".,", self.ids([".", ","])))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.loose and (text.isascii() or is_latin(text)):
            text = text.lower()  # as the library would; for other letters the library's own tables decide
        cut = text.replace("\n", " " if self.loose else " \n").split(" ")
        if not self.loose and "" in cut:
            return self.ids([text])[0]
        # no space stands before the first part, so it is another key, unless spaces do not matter
        first = "" if self.loose else cut[0]
        if not self.loose:
            cut[0] = " " + first
        found = list(map(self.parts.get, cut))
        if not self.loose:
            found[0] = b""
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps or first:
            start, fresh = self.fill(first, {cut[i] for i in gaps})
            if first:
                found[0] = start
            for i in gaps:
                found[i] = fresh[cut[i]]
        try:
            return b"".join(found)
        except TypeError:  # a part of white space alone
            return self.ids([text])[0]

    def fill(self, first: str, new: set[str]) -> tuple[bytes, dict[str, bytes | bool]]:
        """ids of a text's first part, and of the parts that are not known, which are then kept while there is room.

        A full stop or comma behind a letter is a token of its own, so such a part is its word's ids and the mark's.
        """
        known, cut = self.parts, {}
        for p in new:
            if p[-1] in ".," and p[-2:-1].isalpha():
                cut[p] = p[:-1]
        need = list({p for p in (cut.get(p, p) for p in new) if p not in known})
        start, *ids = self.ids([first, *(p if p[0] == "\n" else " " + p for p in need)])
        fresh: dict[str, bytes | bool] = {p: False if not self.loose and p.isspace() else x for p, x in zip(need, ids)}
        for p, word in cut.items():
            fresh[p] = (fresh[word] if word in fresh else known[word]) + self.marks[p[-1]]
        if len(known) + len(fresh) <= self.most:
            known.update(fresh)
        else:
            self.missed += len(need)
            if self.missed > 4 * self.most:
                self.parts, self.missed = {"": b""} if self.loose else {}, 0
        return start, fresh


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str, most: int = MOST_PARTS) -> Encoder:
    """This worker's encoder, kept until a stage of another kind runs in it."""
    return common.held((path, most), lambda: Encoder(path, most))


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
