"""Units of a SentencePiece text: what both piece operators below share.

The model escapes spaces to the marker U+2581 and puts one marker first. No piece holds a marker after
another character, so a text falls into units (a run of markers and what follows up to the next
marker) that never share a piece; each distinct unit is worked on once per worker.
"""

from __future__ import annotations

import re

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


def units(text: str | None) -> list[str]:
    """The units of a text; none for null and empty texts."""
    if not text:
        return []
    s = MARK + text.replace(" ", MARK)
    if MARK + MARK in s:
        return _UNIT.findall(s)
    return s.replace(MARK, "\x00" + MARK).split("\x00")[1:] if "\x00" not in s else _UNIT.findall(s)


class Pieces:
    """Pieces, scores and byte ids of a model file, read through the library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in ids}
        self.score = {self.text[i]: sp.get_score(i) for i in ids}
        self.id = {p: i for i, p in self.text.items()}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(len(sp)) if sp.is_byte(i)}
        self.longest = max(map(len, self.score))
        if len(self.byte_id) != 256 or any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("the model needs byte pieces, and pieces with markers in front only")
