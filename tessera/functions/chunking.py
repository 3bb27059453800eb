"""Recursive character text splitting as a per-text helper.

A text is cut where a separator begins, the coarsest separator that occurs
first. Neighbouring pieces shorter than ``chunk_size`` are put together into
chunks of at most that many characters, each going back over up to
``chunk_overlap`` of the one before; a longer piece is cut again by the finer
separators. All of it is done on offsets: a chunk is a range of the text. It
runs inside Spark tasks (``mapInArrow``) one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

# Fixed values that must equal the reference's for the same results.
DEFAULT_SEPARATORS = ("\n\n", "\n", ".", " ", "")


def _pieces(text: str, begin: int, end: int, separator: str) -> list[tuple[int, int]]:
    """Ranges from one occurrence of the separator to the next; single
    characters for an empty separator."""
    if not separator:
        cuts = list(range(begin + 1, end))
    else:
        cuts, at = [], text.find(separator, begin, end)
        while at >= 0:
            cuts.append(at)
            at = text.find(separator, at + len(separator), end)
        if cuts and cuts[0] == begin:
            del cuts[0]
    return list(zip([begin, *cuts], [*cuts, end]))


def _together(pieces: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring pieces: as many as fit, then back by the overlap."""
    first = 0
    for i, (start, end) in enumerate(pieces):
        if i > first and end - pieces[first][0] > size:
            yield pieces[first][0], start
            while first < i and (start - pieces[first][0] > overlap or end - pieces[first][0] > size):
                first += 1
    yield pieces[first][0], pieces[-1][1]


def chunk_ranges(text: str, chunk_size: int, chunk_overlap: int, separators=DEFAULT_SEPARATORS,
                 begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of the chunks of a text, white space at their ends left out."""
    end = len(text) if end is None else end
    used = next((i for i, s in enumerate(separators) if text.find(s, begin, end) >= 0), len(separators) - 1)
    finer = separators[used + 1:] if separators[used] else ()
    short: list[tuple[int, int]] = []

    def flush():
        if short:
            for a, b in _together(short, chunk_size, chunk_overlap):
                chunk = text[a:b]
                if kept := len(chunk.strip()):
                    a += len(chunk) - len(chunk.lstrip())
                    yield a, a + kept
            short.clear()

    for a, b in _pieces(text, begin, end, separators[used]):
        if b - a < chunk_size:
            short.append((a, b))
            continue
        yield from flush()
        if finer:
            yield from chunk_ranges(text, chunk_size, chunk_overlap, finer, a, b)
        else:
            yield a, b
    yield from flush()


def chunk_with_starts(text: str, chunk_size: int, chunk_overlap: int,
                      separators=DEFAULT_SEPARATORS) -> list[tuple[int, str]]:
    """(start_index, chunk) pairs. The start is where the chunk's text is first
    found from the end of the chunk before, less the overlap."""
    out, search = [], 0
    for a, b in chunk_ranges(text, chunk_size, chunk_overlap, tuple(separators)) if text else ():
        chunk = text[a:b]
        start = text.find(chunk, max(0, search))
        out.append((start, chunk))
        search = start + len(chunk) - chunk_overlap
    return out
