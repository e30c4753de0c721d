"""Personal data: exact patterns, and a character-level BiLSTM-CRF that adds to them.

The patterns' findings are always kept.  The tagger (bidirectional LSTM
emissions, CRF transitions, trained in numpy on the log-likelihood of the tag
sequences) learns from labelled spans in windows of a bounded sample of texts:
the patterns' findings, secrets (long values after a name like `token`), and
made-up spans of all kinds put between the texts' own words, also in forms that
the patterns don't know (`name (at) host dot org`, grouped or masked cards,
phone numbers without a plus), beside made-up numbers, dates and versions that
are none.

Whole texts of any length are read in windows of `WINDOW` characters that
overlap by `OVERLAP`; each is decoded (Viterbi; windows whose best path provably
has no span are not traced), a character takes its tag from the window in which
it lies nearest to the middle, and spans are read off the whole text's tags, so
a span may cross windows.  Tagged spans that can't be of their kind (`plausible`)
or touch a pattern's finding aren't added.

Null text is empty, empty text has no spans; repeated rows are read alike;
without texts to learn from the patterns stand alone; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import bounded_sample, one_row_an_id

#: Kinds with a pattern, and those that only the tagger finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
WINDOW, OVERLAP, TRAINED, HIDDEN, BATCH = 256, 48, 96, 16, 2048
#: Texts that teach, windows of each, and windows in all.
SAMPLE, WINDOWS_A_TEXT, MOST_WINDOWS = 1200, 4, 2000

# A match can't begin inside a run of digits, so the look-behind only saves time on long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)\b[a-z_]*(?:token|secret|passw(?:or)?d|api_?key|access_?key|private_?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/=-]{16,})")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find_patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start; leftmost, not overlapping within a kind, failing matches dropped."""
    out = []
    done = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            begin = m.start()
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < m.start():
                out.append((0, begin, m.end()))
                done = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# Symbols: letters of ASCII (case ignored), digits, other letters, other white space, anything else, and marks of their own.
_OWN = "@.-_+() :/,=\"'%*[]<>#;!?&$\n"
_SYMBOL = np.full(0x250, 29, np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    if _s in _OWN:
        _SYMBOL[_c] = 30 + _OWN.index(_s)
    elif "a" <= _s.lower() <= "z" and _c < 128:
        _SYMBOL[_c] = ord(_s.lower()) - 97
    elif _s.isalnum() or _s.isspace():
        _SYMBOL[_c] = 26 if "0" <= _s <= "9" else 28 if _s.isspace() else 27
SYMBOLS = 30 + len(_OWN) + 1
PAD = SYMBOLS - 1


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x250, _SYMBOL[np.minimum(codes, 0x24F)], np.uint8(27))


def cut_windows(sym: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) over a whole text, padded at the end."""
    step = WINDOW - OVERLAP
    count = max(1, -(-(len(sym) - OVERLAP) // step))
    padded = np.full(count * step + OVERLAP, PAD, np.uint8)
    padded[: len(sym)] = sym
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def _bend(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the squashing function of all gates: several times faster than exponentials."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Slope of the squashing function, from its value."""
    y = 1 - np.abs(y)
    return y * y


class Tagger:
    """BiLSTM emissions and CRF transitions; tag 0 is 'none', tag k + 1 is ALL_KINDS[k]."""

    TAGS = len(ALL_KINDS) + 1

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"out": rng.normal(0, 0.3, (2 * h, self.TAGS)), "bias": np.zeros(self.TAGS), "move": np.zeros((self.TAGS, self.TAGS)), "start": np.zeros(self.TAGS)}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.3, (SYMBOLS, 4 * h)), f"h{d}": rng.normal(0, 0.2, (h, 4 * h)), f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, sym: np.ndarray, d: str):
        n, t = sym.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, tape = np.empty((t, n, HIDDEN), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = self.p[f"x{d}"][sym[:, i]] + h @ self.p[f"h{d}"] + self.p[f"c{d}"]
            bent = _bend(z)
            gate, g = 0.5 + 0.5 * bent[:, : 3 * HIDDEN], bent[:, 3 * HIDDEN :]
            a, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            c_new = f * c + a * g
            top = _bend(c_new)
            tape.append((i, h, c, a, f, o, g, top, _slope(bent)))
            h, c = o * top, c_new
            out[i] = h
        return out, tape

    def _unroll(self, sym: np.ndarray, d: str, tape: list, pull: np.ndarray, grad: dict) -> None:
        gx, gh, gc = (np.zeros_like(self.p[f"{k}{d}"]) for k in "xhc")
        dh = dc = 0.0
        one = np.eye(SYMBOLS, dtype=gx.dtype)
        for i, h, c, a, f, o, g, top, slope in reversed(tape):
            dh = dh + pull[i]
            dc = dc + dh * o * _slope(top)
            dz = np.concatenate([0.5 * dc * g, 0.5 * dc * c, 0.5 * dh * top, dc * a], 1) * slope
            gx += one[sym[:, i]].T @ dz
            gh += h.T @ dz
            gc += dz.sum(0)
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        grad |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}

    def emissions(self, sym: np.ndarray) -> np.ndarray:
        """(time, tags, rows)"""
        n, t = sym.shape
        by_time = np.ascontiguousarray(sym.T)
        emit = np.empty((t, self.TAGS, n), np.float32)
        emit[:] = self.p["bias"][:, None]
        z, size, top, size_c = (np.empty((n, k * HIDDEN), np.float32) for k in (4, 4, 1, 1))
        for k, d in enumerate("fb"):
            x, w = self.p[f"x{d}"] + self.p[f"c{d}"], self.p[f"h{d}"]
            out = np.ascontiguousarray(self.p["out"][k * HIDDEN : (k + 1) * HIDDEN].T)
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                np.take(x, by_time[i], axis=0, out=z, mode="clip")
                z += h @ w
                np.abs(z, out=size)
                size += 1
                z /= size
                gates = z[:, : 3 * HIDDEN]
                gates *= 0.5
                gates += 0.5
                c *= z[:, HIDDEN : 2 * HIDDEN]
                np.multiply(z[:, :HIDDEN], z[:, 3 * HIDDEN :], out=top)
                c += top
                np.abs(c, out=size_c)
                size_c += 1
                np.divide(c, size_c, out=top)
                np.multiply(z[:, 2 * HIDDEN : 3 * HIDDEN], top, out=h)
                emit[i] += out @ h.T
        return emit

    def quiet(self, emit: np.ndarray) -> np.ndarray:
        """Rows whose best path has no span for certain: no stretch of other tags can outweigh 'none', even by the dearest moves."""
        move = self.p["move"]
        stay = move[1:, 1:].max() - move[0, 0]
        edges = max(move[0, 1:].max() - move[0, 0], (self.p["start"][1:] - self.p["start"][0]).max()) + max(move[1:, 0].max() - move[0, 0], 0.0) - stay
        gain = emit[:, 1:].max(1) - emit[:, 0] + stay
        run = most = gain[0]
        for g in gain[1:]:
            run = np.maximum(run, 0) + g
            most = np.maximum(most, run)
        return most + edges < -1e-3

    def viterbi(self, emit: np.ndarray) -> np.ndarray:
        """Best tags (rows, time)."""
        t, k, n = emit.shape
        best, back = emit[0] + self.p["start"][:, None], np.zeros((t, k, n), np.int8)
        for i in range(1, t):
            ways = best[:, None, :] + self.p["move"][:, :, None]
            back[i] = ways.argmax(0)
            best = ways.max(0) + emit[i]
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = best.argmax(0)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][tags[:, i], rows]
        return tags

    def decode(self, sym: np.ndarray) -> np.ndarray:
        """Best tags (rows, time), BATCH rows at a time."""
        tags = np.zeros(sym.shape, np.int8)
        for b in range(0, len(sym), BATCH):
            emit = self.emissions(sym[b : b + BATCH])
            live = np.flatnonzero(~self.quiet(emit))
            if len(live):
                tags[b + live] = self.viterbi(np.ascontiguousarray(emit[:, :, live]))
        return tags

    def _gradient(self, sym: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        forward, tape_f = self._lstm(sym, "f")
        backward, tape_b = self._lstm(sym, "b")
        both = np.concatenate([forward, backward], 2)
        emit = both @ self.p["out"] + self.p["bias"]
        t, n, k = emit.shape
        lse = lambda x, ax: (m := x.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(x - m).sum(ax))
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0] + self.p["start"]
        for i in range(1, t):
            alpha[i] = lse(alpha[i - 1][:, :, None] + self.p["move"], 1) + emit[i]
        for i in range(t - 2, -1, -1):
            beta[i] = lse(self.p["move"] + (emit[i + 1] + beta[i + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        hot = np.eye(k, dtype=np.float32)[tags.T]
        pull = (np.exp(alpha + beta - total[None, :, None]) - hot) / n
        move = -np.einsum("tna,tnb->ab", hot[:-1], hot[1:])
        for i in range(1, t):
            move += np.exp(alpha[i - 1][:, :, None] + self.p["move"] + (emit[i] + beta[i])[:, None, :] - total[:, None, None]).sum(0)
        grad = {"move": move / n, "start": pull[0].sum(0), "out": np.einsum("tnh,tnk->hk", both, pull), "bias": pull.sum((0, 1))}
        back = pull @ self.p["out"].T
        self._unroll(sym, "f", tape_f, back[:, :, :HIDDEN], grad)
        self._unroll(sym, "b", tape_b, back[:, :, HIDDEN:], grad)
        rows = np.arange(n)
        gold = self.p["start"][tags[:, 0]] + sum(emit[i][rows, tags[:, i]] for i in range(t)) + sum(self.p["move"][tags[:, i - 1], tags[:, i]] for i in range(1, t))
        return float((total - gold).mean()), grad

    def fit(self, sym: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 160, seed: int = 1) -> list[float]:
        """Adam on the negative log-likelihood; returns the loss of each epoch."""
        rng, m, v, step, losses = np.random.default_rng(seed), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0, []
        for e in range(epochs):
            order, seen = rng.permutation(len(sym)), []
            for b in range(0, len(order), batch):
                loss, grad = self._gradient(sym[order[b : b + batch]], tags[order[b : b + batch]])
                seen.append(loss)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for key, g in grad.items():
                    g = g * min(1.0, 5.0 / max(size, 1e-9))
                    m[key] = 0.9 * m[key] + 0.1 * g
                    v[key] = 0.999 * v[key] + 0.001 * g * g
                    rate = 0.03 * (0.84**e)
                    self.p[key] = (self.p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses


def reconcile(length: int, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a text from its windows' tags: each character's tag is that of the window in which it is nearest to the middle."""
    if not tags.any():
        return []
    half = OVERLAP // 2
    line = np.concatenate([tags[0, :half], *(w[half : WINDOW - half] for w in tags), tags[-1, WINDOW - half :]])[:length]
    edge = np.flatnonzero(np.diff(line)) + 1
    return [(int(line[a]) - 1, a, z) for a, z in zip([0, *edge.tolist()], [*edge.tolist(), length], strict=True) if z > a and line[a]]


def plausible(kind: int, piece: str) -> bool:
    """Whether a tagged piece of text can be of the kind at all."""
    low, digits = piece.lower(), [c for c in piece if "0" <= c <= "9"]
    if kind == 0:
        return len(piece) >= 7 and ("@" in piece or bool(re.search(r"\bat\b", low))) and ("." in piece or bool(re.search(r"\bdot\b", low))) and "\n" not in piece
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        masked = sum(c in "*xX" for c in piece)
        return (masked >= 4 and 12 <= masked + len(digits) <= 19 and len(digits) >= 4) if masked else 13 <= len(digits) <= 19 and _luhn("".join(digits))
    if kind == 3:
        return 8 <= len(digits) <= 15 and len(piece) <= 2 * len(digits)
    return len(piece) >= 16 and not re.search(r"\s", piece) and 4 <= len(digits) and any(c.isalpha() for c in piece)


def _trim(kind: int, text: str, b: int, e: int) -> tuple[int, int]:
    """Ends at letters and digits; runs of digits, and secrets, as a whole."""
    while b < e and not (text[b].isalnum() or text[b] in "+("):
        b += 1
    while e > b and not (text[e - 1].isalnum() or kind == 2 and text[e - 1] == "*"):
        e -= 1
    if e > b:
        more = (lambda c: c.isalnum() or c in "_+/-") if kind == 4 else (lambda c: "0" <= c <= "9")
        while b and more(text[b - 1]):
            b -= 1
        while e < len(text) and more(text[e]):
            e += 1
    return b, e


class Finder:
    """Patterns and tagger over batches of whole texts."""

    def __init__(self, tagger: Tagger | None):
        self.tagger = tagger

    def _tagged(self, texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
        """Spans of each text by the tagger alone; windows of many texts are decoded together."""
        group: list[tuple[int, np.ndarray]] = []
        for i, t in enumerate(texts):
            group.append((len(t), cut_windows(symbols(t)) if t else np.empty((0, WINDOW), np.uint8)))
            if i == len(texts) - 1 or sum(len(w) for _, w in group) >= BATCH:
                tags, row = self.tagger.decode(np.concatenate([w for _, w in group])), 0
                for length, w in group:
                    yield reconcile(length, tags[row : row + len(w)]) if len(w) else []
                    row += len(w)
                group = []

    def find(self, texts: list[str]) -> Iterator[tuple[list, list]]:
        """(pattern spans, all spans) for each text."""
        tagged = self._tagged(texts) if self.tagger else iter([[]] * len(texts))
        for t, more in zip(texts, tagged, strict=True):
            base = find_patterns(t)
            own, taken = list(base), sorted((b, e) for _, b, e in base)
            for kind, b, e in more:
                b, e = _trim(kind, t, b, e)
                if e > b and plausible(kind, t[b:e]) and not any(x < e and b < y for x, y in taken):
                    own.append((kind, b, e))
                    taken.append((b, e))
            yield base, sorted(own)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def labelled_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that a text of the sample teaches: the patterns' findings and values of secrets."""
    return find_patterns(text) + [(4, *m.span(1)) for m in _SECRET.finditer(text)]


def made_span(r: random.Random) -> tuple[int | None, str]:
    """(kind, made-up text); kind None for what is no personal data."""
    word = lambda a, b: "".join(r.choice("abcdefghiklmnoprstuvwyz") for _ in range(r.randint(a, b)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    kind = r.randrange(8)
    if kind == 0:
        at, dot = r.choice([("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", "."), ("(at)", ".")])
        return 0, word(2, 9) + r.choice(["", ".", "_", number(2)]) + word(0, 6) + at + word(3, 9) + r.choice(["", number(1), dot + word(3, 8)]) + dot + r.choice(["com", "org", "net", "de", "es", "fr", "info"])
    if kind == 1:
        return 1, r.choice([".", ".", " . ", "[.]", "-", "(.)"]).join(str(r.randrange(256)) for _ in range(4))
    if kind == 2:
        parts = [number(4) for _ in range(4)]
        if r.random() < 0.4:
            parts[1:3] = [r.choice(["****", "xxxx", "XXXX"])] * 2
        return 2, r.choice(["", " ", "-", ".", "  "]).join(parts)
    if kind == 3:
        return 3, r.choice([f"+{r.randrange(1, 99)} ", f"00{r.randrange(1, 99)} ", "", "+", "0"]) + r.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)} {number(3)} {number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}/{number(7)}", f"{number(3)}.{number(3)}.{number(4)}"])
    if kind == 4:
        alphabet = r.choice(["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
        return 4, "".join(r.choice(alphabet) for _ in range(r.randint(20, 64)))
    if kind == 5:
        return None, r.choice([str(r.randrange(10**7)), f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", f"{r.randrange(24)}:{number(2)}", f"{r.randrange(9)}.{r.randrange(20)}.{r.randrange(20)}", f"{r.randrange(999)},{number(3)}.{number(2)}", f"{number(2)}/{number(2)}/{number(4)}"])
    if kind == 6:
        return None, r.choice([f"{word(3, 8)} at {word(3, 8)}", f"{word(3, 8)}.{word(2, 8)}", f"http://{word(3, 8)}.{word(3, 8)}.org/{word(2, 5)}", f"@{word(3, 9)}", f"{word(3, 9)} (dot) {word(2, 5)}", f"{word(4, 9)}_{word(3, 9)}_{word(3, 9)}"])
    return None, word(12, 40)


def taught_windows(text: str, windows: int = WINDOWS_A_TEXT) -> Iterator[tuple[bytes, bytes]]:
    """Up to `windows` labelled windows (symbols, tags) of one text, drawn by a hash of the text: its own spans, and made-up ones between its words."""
    r, found = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))), labelled_spans(text)
    for i in range(windows):
        own = found[r.randrange(len(found))] if found and i < 2 else None
        at = max(0, (own[1] if own else r.randrange(len(text) + 1)) - r.randrange(TRAINED))
        line = np.zeros(len(text[at : at + 3 * TRAINED]), np.uint8)
        for kind, b, e in found:
            if b < at + len(line) and e > at:
                line[max(0, b - at) : e - at] = kind + 1
        piece = text[at : at + len(line)]
        if own is None and i % 4:
            kind, said = made_span(r)
            cut = r.randint(0, min(len(piece), TRAINED - 8))
            while 0 < cut < len(piece) and (line[cut - 1] and line[cut]):
                cut -= 1
            lead = r.choice([" ", "\n", " (", ": ", " "]) + (r.choice(["token", "secret", "api_key", "password", "TOKEN"]) + r.choice([" = \"", "=\"", ": ", " = '", ":\""]) if kind == 4 else "")
            tail = r.choice([" ", ", ", ". ", ") ", "\n", "\" "])
            tags = np.full(len(said), 0 if kind is None else kind + 1, np.uint8)
            piece = piece[:cut] + lead + said + tail + piece[cut:]
            line = np.concatenate([line[:cut], np.zeros(len(lead), np.uint8), tags, np.zeros(len(tail), np.uint8), line[cut:]])
        sym, tag = np.full(TRAINED, PAD, np.uint8), np.zeros(TRAINED, np.uint8)
        n = min(TRAINED, len(piece))
        sym[:n], tag[:n] = symbols(piece[:n]), line[:n]
        yield sym.tobytes(), tag.tobytes()


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in batches:
        rows = [w for text in _texts(table.column(0)) for w in taught_windows(text)]
        yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in rows], pa.binary()) for i in (0, 1)], names=["sym", "tag"])


FOUND = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Tagger | None:
    """Train on windows of at most `sample` texts, chosen by hash of their id (one row an id)."""
    able = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> '' AND id IS NOT NULL")
    picked = bounded_sample(able.select("id", F.lit("text").alias("label")), "label", sample)
    texts = one_row_an_id(able.join(F.broadcast(picked.select("id")), "id"), ["id"], "text")
    rows = texts.select("text").mapInArrow(_label, "sym binary, tag binary").collect()
    rows = sorted({(bytes(r.sym), bytes(r.tag)) for r in rows}, key=lambda r: hashlib.md5(r[0] + r[1]).digest())[:MOST_WINDOWS]
    if not any(any(t) for _, t in rows):
        return None
    sym, tag = (np.array([np.frombuffer(r[i], np.uint8) for r in rows]) for i in (0, 1))
    tagger = Tagger()
    tagger.fit(sym, tag)
    return tagger


def find(docs: DataFrame, tagger: Tagger | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a row of docs: doc_id, base and spans (kind, start, end in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for table in batches:
            for b in range(0, table.num_rows, 1000):
                part = table.slice(b, 1000)
                base, spans = zip(*finder.find(_texts(part.column(1))), strict=True)
                named = [[[{"kind": ALL_KINDS[k], "start": x, "end": y} for k, x, y in row] for row in side] for side in (base, spans)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named[0], _SPAN), pa.array(named[1], _SPAN)], names=["doc_id", "base", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the patterns' findings, their digest, all spans as text, and the numbers of secrets, of added and of all spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    more = [F.size(F.filter("spans", _is("secret"))).cast("long").alias("n_secret"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more)


def _is(kind: str):
    return lambda s: s["kind"] == kind
