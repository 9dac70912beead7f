"""Pre-tokenisation without regular expressions.

Every code point has a class (letter, number, other, white space).  A finite automaton over
classes says where a token starts.  Each character is then a function from state to state;
those functions form a small finite monoid whose product is a table, so the states of a whole
batch come from an associative scan: every block of characters is reduced to one function,
a doubling scan over blocks gives the state each block begins in, and a last pass marks starts.
All passes are vectorised over blocks; none looks at a text by itself.

The automaton is that of the public byte-level pattern: contractions, then letters, numbers or
other characters with one optional space before them, then white space, of which the last
character before a word is left to the word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# Classes with what follows taken in: an apostrophe of a contraction with one or two letters, a blank before a word,
# other white space before a word, white space before white space or the end, and the end of a text.
SHORT, LONG, JOIN, SOLO, RUN, END = 3, 4, 5, 6, 7, 8
N_CLASSES = 9
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, ONE_LEFT, TWO_LEFT, IN_SPACE = range(8)
N_STATES = 8
BLOCK = 256


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at a character of this class."""
    if kind == END:
        return FRESH, True
    if kind == JOIN:
        return JOINED, True
    if kind == SOLO:
        return FRESH, True
    if kind == RUN:
        return IN_SPACE, state != IN_SPACE
    if kind == LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINED)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINED)
    if state in (IN_OTHERS, JOINED):
        return IN_OTHERS, False
    return {SHORT: ONE_LEFT, LONG: TWO_LEFT}.get(kind, IN_OTHERS), True


@lru_cache(maxsize=1)
def _tables():
    """Step table, start table, and the monoid: element after one more class, product, image of the fresh state."""
    nxt = np.array([[_step(s, c)[0] for c in range(N_CLASSES)] for s in range(N_STATES)])
    start = np.array([[_step(s, c)[1] for c in range(N_CLASSES)] for s in range(N_STATES)])
    elements, number = [tuple(range(N_STATES))], {tuple(range(N_STATES)): 0}
    after = []
    for f in elements:  # grows while it is read: closure under the generators
        row = []
        for c in range(N_CLASSES):
            g = tuple(int(nxt[s, c]) for s in f)
            if g not in number:
                number[g] = len(elements)
                elements.append(g)
            row.append(number[g])
        after.append(row)
    m = len(elements)
    product = np.array([number[tuple(g[s] for s in f)] for f in elements for g in elements], dtype=np.intp)
    return nxt.ravel().astype(np.intp), start.ravel(), np.array(after, dtype=np.intp).ravel(), product, m, np.array([f[FRESH] for f in elements], dtype=np.intp)


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """For each class in ``kinds`` (which ends with END), whether a token starts there."""
    nxt, start, after, product, m, fresh = _tables()
    n = len(kinds)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, END, dtype=np.uint8)
    padded[:n] = kinds
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp)
    function = np.zeros(blocks, dtype=np.intp)
    for row in grid:
        function = after[function * N_CLASSES + row]
    step = 1
    while step < blocks:
        function[step:] = product[function[:-step] * m + function[step:]]
        step *= 2
    state = np.empty(blocks, dtype=np.intp)
    state[0], state[1:] = FRESH, fresh[function[:-1]]
    out = np.empty((BLOCK, blocks), dtype=bool)
    for row, marks in zip(grid, out, strict=True):
        at = state * N_CLASSES + row
        marks[:] = start[at]
        state = nxt[at]
    return out.T.reshape(-1)[:n]


def kinds_of(points: np.ndarray, classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of code points with what follows taken in; ``ends`` are the places that close a text."""
    base = classes[points]
    base[ends] = END
    kinds = base.copy()
    white = np.flatnonzero(base == SPACE)
    follower = base[white + 1]
    before_word = (follower != SPACE) & (follower != END)
    kinds[white] = np.where(before_word, np.where(points[white] == 0x20, JOIN, SOLO), RUN)
    quote = np.flatnonzero(points == 0x27)
    quote = quote[base[quote] != END]
    if len(quote):
        last = len(points) - 1
        a, b = points[quote + 1], points[np.minimum(quote + 2, last)]
        closed = base[quote + 1] == END
        one = ~closed & np.isin(a, [ord(c) for c in "stmd"])
        two = ~closed & (base[np.minimum(quote + 2, last)] != END) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        kinds[quote[one]], kinds[quote[two]] = SHORT, LONG
    return kinds


def split_bytes(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the joined texts, token starts and ends in them, and the first token of each text (one more than texts)."""
    none = np.zeros(0, dtype=np.int64)
    if not texts:
        return none.astype(np.uint8), none, none, np.zeros(1, dtype=np.int64)
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    kinds = kinds_of(points, classes, ends)
    starts = np.flatnonzero(token_starts(kinds))
    real = kinds[starts] != END
    stops = np.append(starts[1:], len(points))[real]
    starts = starts[real]
    first = np.append(0, np.searchsorted(starts, ends))
    raw = np.frombuffer(joined.encode(), dtype=np.uint8)
    if len(raw) != len(points):
        at = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)))
        starts, stops = at[starts], at[stops]
    return raw, starts, stops, first


def _all_points() -> str:
    return np.append(np.arange(0xD800), np.arange(0xE000, 0x110000)).astype("<u4").tobytes().decode("utf-32-le")


@lru_cache(maxsize=1)
def rank_file_classes() -> np.ndarray:
    """Classes as the engine behind rank files sees them, asked of that engine once per worker."""
    import tiktoken

    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (NUMBER, r"\p{N}"), (LETTER, r"\p{L}")):
        engine = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        members = bytes(engine.encode_ordinary(_all_points())).decode()
        classes[np.frombuffer(members.encode("utf-32-le"), dtype="<u4")] = kind
    return classes


@lru_cache(maxsize=1)
def json_file_classes() -> np.ndarray:
    """Classes as the library for ``.json`` files sees them."""
    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    everything = _all_points()
    points = np.frombuffer(everything.encode("utf-32-le"), dtype="<u4")
    for kind, pattern, mark in ((SPACE, r"\s", "!"), (NUMBER, r"\p{N}", "!"), (LETTER, r"\p{L}", "!")):
        marked = Replace(Regex(pattern), mark).normalize_str(everything)
        hit = np.frombuffer(marked.encode("utf-32-le"), dtype="<u4") != points
        classes[points[hit]] = kind
    return classes
