"""Gated recurrent language model with a class-factored softmax, and an add-one unigram base beside it.

Words are white-space separated bytes of lower-cased text; one end token closes each text.

*Counts* come from all training texts: a distributed word count gives every token's count, the number of tokens N and of
distinct tokens V.  The ``VOCAB`` most frequent tokens (a parameter) are output words in frequency classes.  All other
tokens fall, by a fixed function of their spelling, in one of ``RARE`` rare classes, and inside a rare class have
probability (c + 1) / (N_r + V_r + 1) from the full counts, so the model's distribution covers every token.

*The network* (GRU; truncated backpropagation in numpy with state carried across windows) predicts a frequency class,
then the output within it.  It learns from every training text, whole: the texts are dealt by
hash to as many copies of the network as they have tokens for, however the rows lay, in rounds; after each round the copies
are averaged by their tokens and the next part of the texts goes on from there.

*Scoring* reads whole texts: windows of ``WINDOW`` steps with the state carried from one to the next, so a text's score
is its complete log-likelihood.  Counts of the ``KNOWN`` most frequent tokens travel to the executors (bounded); tokens
beyond them are joined to the count table by a shuffle and summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapreplace
from math import log10, prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm.common import bernoulli_fold, record_batch, written

END = b" "  # no word holds a space
FOLDS, HELD_OUT = 7, 2
VOCAB = 4095
RARE = 64
CLASS_SIZE = 64
KNOWN = 131_072
KNOWN_BYTES = 64
#: Of longer tokens, so many of the most frequent travel too, up to so many bytes each: what is left is rare.
LONG_KNOWN, LONG_BYTES = 1024, 4096
HIDDEN = 32
WINDOW = 64
LANES = 256
ROWS = 1024  # texts split at a time
#: Texts are scored together until they have so many tokens, so that a long one is a small part of them.
SCORED_TOKENS = 1 << 22
#: Tokens are counted in stretches of about so many before they leave the task.
COUNT_TOKENS = 2_000_000
TRAIN_LANES, TRAIN_WINDOW = 256, 24
SHORT_RUN = 6
STRIP = 1024
#: Texts are learned from in stretches of about so many tokens (a text is never cut).
TRAIN_TOKENS = 1 << 21
#: A copy of the network learns from about so many tokens between two averages; at most so many copies learn side by side.
COPY_TOKENS, TRAINERS = 6_000_000, 65_536
RATE = 0.004
CHUNKS = 64
LOG10E = 1 / np.log(10)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts (strings without nulls), and where each text's words begin and the last one's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, edge = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at a text's ends leaves empty strings
    if not real.all():
        words = words.filter(pa.array(real))
        edge = np.concatenate([[0], np.cumsum(real)])[edge]
    return words.cast(pa.binary()), edge


MARKS = ".,;:!?*|%&$#\"')"


def rare_class(word: bytes) -> int:
    """Rare class of a token: its last two letters and whether marks or non-ASCII letters occur."""
    core = word.rstrip(MARKS.encode())
    marked = len(core) != len(word)
    tail = core[-2:]
    value = 0
    for b in tail:
        value = (value * 31 + b) & 0xFFFF
    if len(word) > 40:
        return 0
    return (value * 2 + marked) % (RARE - 2) + 2 if tail else 1


def rare_classes(words: pa.Array) -> np.ndarray:
    """``rare_class`` of each token."""
    core = pc.ascii_rtrim(words.view(pa.string()), characters=MARKS)
    size, left = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (words, core))
    data, stop = core.buffers()[2], np.cumsum(left)  # what a kernel has made begins at 0
    letters = np.concatenate([np.zeros(2, np.uint8), np.frombuffer(data or b"", np.uint8)]).astype(np.int64)
    value = np.where(left > 1, letters[stop] * 31, 0) + letters[stop + 1]
    out = (value * 2 + (left < size)) % (RARE - 2) + 2
    out[left == 0] = 1
    out[size > 40] = 0
    return out


# ---------------------------------------------------------------- counts


def token_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(token binary, n) over all texts, counted by the stretch in each task before the shuffle."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = pc.value_counts(pa.chunked_array(held, pa.binary()))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.column(0).slice(at, ROWS)
                words, _ = split_words(part)
                held.append(words)
                size, texts = size + len(words), texts + len(part)
                if size >= COUNT_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()
        if texts:
            yield record_batch(schema, [END], [texts])

    return df.select(F.col(text_col).alias("t")).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- network


@dataclass
class Net:
    """Embedding already multiplied into the gates (E: outputs x 3H), recurrent U, biases, class and word softmax.

    Outputs are the words by frequency, then the rare classes; ``CLASS_SIZE`` neighbours make a softmax class.
    """

    E: np.ndarray
    U: np.ndarray
    b: np.ndarray
    Wc: np.ndarray
    bc: np.ndarray
    Ww: np.ndarray
    bw: np.ndarray

    def names(self):
        return list(self.__dataclass_fields__)

    def pack(self) -> bytes:
        """All parameters one after the other."""
        return np.concatenate([getattr(self, k).ravel() for k in self.names()]).astype(np.float32).tobytes()

    def unpacked(self, flat: np.ndarray) -> Net:
        out, at = [], 0
        for k in self.names():
            own = getattr(self, k)
            out.append(flat[at : at + own.size].astype(np.float32).reshape(own.shape))
            at += own.size
        return Net(*out)


def new_net(n_out: int, hidden: int, seed: int = 1) -> Net:
    rng = np.random.default_rng(seed)
    f = np.float32
    classes = -(-n_out // CLASS_SIZE)
    r = lambda *s: rng.normal(0, 0.08, s).astype(f)
    return Net(
        r(n_out, 3 * hidden), r(hidden, 3 * hidden), np.zeros(3 * hidden, f),
        r(hidden, classes), np.zeros(classes, f),
        r(classes, CLASS_SIZE, hidden), np.zeros((classes, CLASS_SIZE), f),
    )


def unigram_net(counts: np.ndarray, hidden: int = HIDDEN) -> Net:
    """A new net whose output biases give the outputs' shares of ``counts``."""
    net = new_net(len(counts), hidden)
    flat = np.full(net.bw.size, 1e-26)  # numbers that no output has
    flat[: len(counts)] = counts + 0.1
    per = flat.reshape(net.bw.shape)
    net.bc[:] = np.log(per.sum(1) / per.sum())
    net.bw[:] = np.log(per / per.sum(1, keepdims=True))
    return net


@dataclass
class Gates:
    """What steps read of a net, a block a gate, so that every operation runs over whole blocks: gate sums of each output
    (3 x outputs x H) and recurrent weights (3 x H x H).  Of the update and the reset gate they are negated, as sigmoids
    take them."""

    x: np.ndarray
    U: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, U: np.ndarray) -> Gates:
        x, U = (np.array(a.reshape(len(a), 3, -1).swapaxes(0, 1), order="C") for a in (x, U))
        for a in (x, U):
            np.negative(a[:2], a[:2])
        return cls(x, U)

    def step(self, x: np.ndarray, h: np.ndarray, g: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
        """From gate sums of the inputs and the state: ``g`` gets both gates and the recurrent part of the candidate, ``c``
        the candidate, ``out`` the new state."""
        np.matmul(h, self.U, out=g)
        zr = g[:2]
        zr += x[:2]
        np.exp(zr, zr)
        zr += 1
        np.reciprocal(zr, zr)
        np.multiply(zr[1], g[2], out=c)
        c += x[2]
        np.tanh(c, c)
        np.subtract(h, c, out=out)
        out *= zr[0]
        out += c


class Scratch:
    """Arrays written anew in every window, by name: their memory is kept, and not given back and cleared for each."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def walked(gates: Gates, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, room: Scratch, keep: bool) -> tuple[np.ndarray, ...]:
    """States after each step over the inputs ``x`` (steps x lanes, rows of ``gates.x``) and, if they are to be kept, the
    states before each step and what the steps left (gates, candidates).  Where ``fresh``, a text starts from the zero state."""
    (T, L), H = x.shape, h.shape[1]
    kept = T if keep else 1
    hs, into, g, c = room("hs", T, L, H), room("into", kept, L, H), room("g", kept, 3, L, H), room("c", kept, L, H)
    sums = room("sums", 3, T * L, H)
    for k in range(3):
        np.take(gates.x[k], x.reshape(-1), 0, out=sums[k], mode="clip")
    sums = sums.reshape(3, T, L, H)
    renewed = fresh.any(1).tolist()
    for t in range(T):
        at = t if keep else 0
        into[at] = h
        if renewed[t]:
            into[at][fresh[t]] = 0
        h = hs[t]
        gates.step(sums[:, t], into[at], g[at], c[at], h)
    return hs, into, g, c


def gru_step(net: Net, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New state, both gates, candidate and the recurrent part of the candidate; the input's gate sums are given."""
    gates = Gates.of(x, net.U)
    g, c, out = np.empty_like(gates.x), np.empty_like(h), np.empty_like(h)
    gates.step(gates.x, h, g, c, out)
    return out, g[:2], c, g[2]


def bounded(net: Net) -> bool:
    """Whether float32 exponentials of all logits sum safely without a shift: states lie within -1 and 1."""
    wide = lambda w, b, axis: (np.abs(w).sum(axis), b)
    for reach, bias in (wide(net.Wc.T[None], net.bc[None], 2), wide(net.Ww, net.bw, 2)):
        if (bias + reach).max() > 70 or (bias - reach).max(1).min() < -70:
            return False
    return True


def _exponentials(logits: np.ndarray, safe: bool) -> np.ndarray | None:
    """In place; where they would not sum safely, less each row's maximum, which is returned."""
    top = None if safe else logits.max(1)
    if top is not None:
        logits -= top[:, None]
    np.exp(logits, logits)
    return top


def log_softmax_at(logits: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """log softmax at one column of each row; ``logits`` is overwritten."""
    got = logits[np.arange(len(at)), at]
    top = _exponentials(logits, safe)
    out = got - np.log(logits @ np.ones(logits.shape[1], np.float32))
    return out if top is None else out - top


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and (class, from, to) of each class in it."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cs = cls[order]
    edge = np.concatenate([[0], np.nonzero(np.diff(cs))[0] + 1, [len(cs)]]).tolist() if len(cs) else [0]
    return order, [(int(cs[a]), a, b) for a, b in zip(edge[:-1], edge[1:])]


def _strips(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(from, to, parts within) of stretches of about ``STRIP`` rows, whose logits a core's cache holds; long parts are cut."""
    out, held, first = [], [], 0
    for k, a, b in ((k, i, min(i + STRIP, b)) for k, a, b in parts for i in range(a, b, STRIP)):
        held.append((k, a - first, b - first))
        if b - first >= STRIP:
            out.append((first, b, held))
            held, first = [], b
    return [*out, (first, first + held[-1][2], held)] if held else out


def _word_logits(net: Net, h: np.ndarray, parts: list[tuple[int, int, int]], out: np.ndarray | None = None) -> np.ndarray:
    out = np.empty((len(h), CLASS_SIZE), np.float32) if out is None else out
    for k, a, b in parts:
        np.matmul(h[a:b], net.Ww[k].T, out=out[a:b])
        out[a:b] += net.bw[k]
    return out


def log_probs(net: Net, h: np.ndarray, target: np.ndarray, safe: bool = False) -> np.ndarray:
    """Natural log probability of each target output from its state: of its class, then of it within the class."""
    order, parts = _by_class(target // CLASS_SIZE)
    h, target = np.take(h, order, 0), target[order]
    found = np.empty(len(h))
    for a, b, own in _strips(parts):
        classes = h[a:b] @ net.Wc
        classes += net.bc
        found[a:b] = log_softmax_at(classes, target[a:b] // CLASS_SIZE, safe)
        found[a:b] += log_softmax_at(_word_logits(net, h[a:b], own), target[a:b] % CLASS_SIZE, safe)
    out = np.empty(len(found))
    out[order] = found
    return out


def segment_sums(rows: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows (the last axis but one) that begin at ``edge``; most are short, and those are added
    side by side."""
    n_rows = rows.shape[-2]
    out = np.empty((*rows.shape[:-2], len(edge), rows.shape[-1]), np.float32)
    size = np.diff(np.append(edge, n_rows))
    for k in range(1, SHORT_RUN + 1):
        at = np.nonzero(size == k)[0]
        first = edge[at]
        total = np.take(rows, first, -2)
        for j in range(1, k):
            total += np.take(rows, first + j, -2)
        out[..., at, :] = total
    ones = np.ones(n_rows, np.float32)
    for i in np.nonzero(size > SHORT_RUN)[0].tolist():
        n = size[i]
        np.matmul(ones[:n], rows[..., edge[i] : edge[i] + n, :], out=out[..., i, :])
    return out


class Trainer:
    """Truncated backpropagation with Adam: windows of ``TRAIN_WINDOW`` steps of parallel lanes, the state carried on."""

    def __init__(self, net: Net, start: int, rate: float):
        self.net, self.start, self.rate, self.steps, self.safe = net, start, rate, 0, bounded(net)
        self.room = Scratch()
        self.m = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
        self.v = {k: np.zeros_like(getattr(net, k)) for k in net.names()}

    def learn(self, stream: np.ndarray) -> None:
        """One pass over whole texts laid end to end, each closed by the start token.

        The stream is cut into lanes side by side; the last lane is filled up with places that teach nothing.
        """
        size = len(stream)
        lanes = max(1, min(TRAIN_LANES, size // (4 * TRAIN_WINDOW)))
        n = -(-size // lanes)
        filled = np.concatenate([stream, np.full(n * lanes - size, self.start, stream.dtype)])
        teaches = np.arange(n * lanes) < size
        text, teaches = filled.reshape(lanes, n).T.astype(np.int64), teaches.reshape(lanes, n).T
        h = np.zeros((lanes, self.net.U.shape[0]), np.float32)
        prev = np.full(lanes, self.start)
        for at in range(0, n, TRAIN_WINDOW):
            y, on = text[at : at + TRAIN_WINDOW], teaches[at : at + TRAIN_WINDOW]
            x = np.concatenate([prev[None], y[:-1]])
            prev = y[-1]
            h = self._window(x, y, h, None if on.all() else on)

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, on: np.ndarray | None) -> np.ndarray:
        net, H, room = self.net, h.shape[1], self.room
        T, L = y.shape
        N = T * L
        fresh = x == self.start
        renewed = fresh.any(1).tolist()
        order = np.argsort(x.reshape(-1).astype(np.uint16), kind="stable")
        sorted_x = x.reshape(-1)[order]
        edge = np.concatenate([[0], np.nonzero(np.diff(sorted_x))[0] + 1])
        inputs, at = sorted_x[edge], np.empty(N, np.int64)
        at[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, N)))
        hs, into, g, c = walked(Gates.of(net.E[inputs] + net.b, net.U), at.reshape(T, L), fresh, h, room, True)
        grads: dict = {}
        dh_out = _output_grads(net, hs.reshape(N, H), y.reshape(-1), grads, None if on is None else on.reshape(-1), self.safe, room).reshape(T, L, H)
        dx, du = room("dx", 3, T, L, H), room("du", L, H)  # by the gate sums; of the candidate, by its recurrent part
        dh, rest, back = np.zeros((L, H), np.float32), room("rest", L, H), room("back", 3, L, H)
        U, dU, part = np.ascontiguousarray(net.U.reshape(H, 3, H).transpose(1, 2, 0)), np.zeros((3, H, H), np.float32), room("part", 3, H, H)
        for t in range(T - 1, -1, -1):
            dh += dh_out[t]
            (z, r, u), own = g[t], dx[:, t]
            np.subtract(1, z, out=rest)
            rest *= dh
            np.multiply(c[t], c[t], out=own[2])
            np.subtract(1, own[2], out=own[2])
            own[2] *= rest
            np.subtract(into[t], c[t], out=own[0])
            own[0] *= rest
            own[0] *= z
            np.multiply(own[2], r, out=du)
            np.multiply(du, u, out=own[1])
            np.subtract(1, r, out=rest)
            own[1] *= rest
            dh *= z
            np.matmul(own[:2], U[:2], out=back[:2])
            np.matmul(du, U[2], out=back[2])
            for k in range(3):
                dh += back[k]
            np.matmul(into[t].T, own[:2], out=part[:2])
            np.matmul(into[t].T, du, out=part[2])
            dU += part
            if renewed[t]:
                dh[fresh[t]] = 0
        flat = dx.reshape(3, N, H)
        grads["U"], grads["b"] = dU.swapaxes(0, 1).reshape(H, 3 * H), (np.ones(N, np.float32) @ flat).reshape(-1)
        sorted_rows = room("sums", 3, N, H)  # the sums of the inputs are not read any more
        for k in range(3):
            np.take(flat[k], order, 0, out=sorted_rows[k], mode="clip")
        of_inputs = segment_sums(sorted_rows, edge).swapaxes(0, 1).reshape(len(edge), 3 * H)
        self.steps += 1
        if self.steps % 32 == 0:  # no logit moves far in so few steps
            self.safe = bounded(net)
        rate = self.rate / (1 + self.steps / 400) ** 0.5
        scale = np.float32(1.0 / (T * L))
        self._adam("E", of_inputs * scale, rate, inputs)
        for k in ("U", "b", "Wc", "bc"):
            self._adam(k, np.clip(grads[k] * scale, -1, 1), rate)
        for k in ("Ww", "bw"):
            rows, g = grads[k]
            self._adam(k, g * scale, rate, rows if len(rows) < len(getattr(net, k)) else slice(None))
        return hs[-1].copy()

    def _adam(self, name: str, g: np.ndarray, rate: float, rows=slice(None), b1=0.9, b2=0.99) -> None:
        m, v = self.m[name][rows], self.v[name][rows]
        square = g * g
        square *= np.float32(1 - b2)
        v *= np.float32(b2)
        v += square
        m *= np.float32(b1)
        m += g * np.float32(1 - b1)
        self.m[name][rows], self.v[name][rows] = m, v
        step = np.sqrt(v, out=square)
        step += np.float32(1e-8)
        np.divide(m, step, step)
        step *= np.float32(rate * (1 - b2**self.steps) ** 0.5 / (1 - b1**self.steps))
        getattr(self.net, name)[rows] -= step


def _output_grads(net: Net, h: np.ndarray, y: np.ndarray, grads: dict, on: np.ndarray | None, safe: bool, room: Scratch) -> np.ndarray:
    order, parts = _by_class(y // CLASS_SIZE)
    hs, ys = np.take(h, order, 0, out=room("ordered", *h.shape), mode="clip"), y[order]
    each = np.arange(len(ys))
    ones = np.ones(len(ys), np.float32) if on is None else on[order].astype(np.float32)

    def slope(logits: np.ndarray, at: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Gradient of the loss by the logits, which are overwritten."""
        _exponentials(logits, safe)
        logits *= (ones / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
        logits.reshape(-1)[each[: len(at)] * logits.shape[1] + at] -= ones
        return logits

    dh, by_word = room("dh", *h.shape), room("by_word", *h.shape)
    back = np.ascontiguousarray(net.Wc.T)
    rows = np.array([k for k, _, _ in parts])
    place = {k: i for i, k in enumerate(rows.tolist())}
    grads["Wc"], grads["bc"] = np.zeros_like(net.Wc), np.zeros_like(net.bc)
    gw, gb = np.zeros((len(rows), CLASS_SIZE, h.shape[1]), np.float32), np.zeros((len(rows), CLASS_SIZE), np.float32)
    for first, last, own in _strips(parts):
        x, at, teach = hs[first:last], ys[first:last], ones[first:last]  # rows that teach nothing get zeros
        p = np.matmul(x, net.Wc, out=room("classes", len(x), len(net.bc)))
        p += net.bc
        slope(p, at // CLASS_SIZE, teach)
        grads["Wc"] += x.T @ p
        grads["bc"] += teach @ p
        np.matmul(p, back, out=dh[first:last])
        q = slope(_word_logits(net, x, own, room("words", len(x), CLASS_SIZE)), at % CLASS_SIZE, teach)
        for k, a, b in own:
            gw[place[k]] += q[a:b].T @ x[a:b]
            gb[place[k]] += teach[a:b] @ q[a:b]
            np.matmul(q[a:b], net.Ww[k], out=by_word[first + a : first + b])
    dh += by_word
    grads["Ww"], grads["bw"] = (rows, gw), (rows, gb)
    out = by_word
    out[order] = dh
    return out


# ---------------------------------------------------------------- scoring


def lanes_of(sizes: np.ndarray, most: int = LANES) -> list[list[int]]:
    """Texts one behind the other in at most ``most`` lanes of nearly the same length, the longest lane first."""
    lanes: list[list[int]] = [[] for _ in range(min(most, len(sizes)))]
    open_ = [(0, k) for k in range(len(lanes))]
    for i in np.argsort(-sizes, kind="stable").tolist():  # each next longest to the shortest lane
        size, k = open_[0]
        lanes[k].append(i)
        heapreplace(open_, (size + int(sizes[i]), k))
    return [lanes[k] for _, k in sorted(open_, reverse=True)]


def stream_scores(net: Net, texts: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log-likelihood of each stream of outputs, all closed by the start token, which occurs nowhere else in them.

    Streams share lanes, so that few lanes stand idle beside a long one.
    """
    if not texts:
        return np.zeros(0)
    lanes = lanes_of(np.array([len(t) for t in texts]))
    laid = [np.concatenate([texts[i] for i in lane]) for lane in lanes]
    size = np.array([len(x) for x in laid])
    out, safe, room = np.zeros(len(texts)), bounded(net), Scratch()
    gates = Gates.of(net.E + net.b, net.U)
    #: The number, lane by lane, of the text that a lane has begun last.
    at = np.concatenate([[0], np.cumsum([len(lane) for lane in lanes])[:-1]]) - 1
    h, prev = np.zeros((len(lanes), net.U.shape[0]), np.float32), np.full(len(lanes), start)
    for w in range(0, int(size[0]), WINDOW):
        live = int((size > w).sum())
        T = min(WINDOW, int(size[0]) - w)
        y = np.zeros((T, live), np.int64)
        for k in range(live):
            part = laid[k][w : w + T]
            y[: len(part), k] = part
        on = np.arange(w, w + T)[:, None] < size[:live]
        x = np.concatenate([prev[None, :live], y[:-1]])
        fresh = x == start
        hs, *_ = walked(gates, x, fresh, h[:live], room, False)
        number = at[:live] + np.cumsum(fresh, 0)
        at, prev, h = number[-1], y[-1], hs[-1].copy()
        flat, number, y = hs.reshape(T * live, -1), number.reshape(-1), y.reshape(-1)
        if not on.all():
            on = on.reshape(-1)
            flat, number, y = flat[on], number[on], y[on]
        out += np.bincount(number, log_probs(net, flat, y, safe), len(out))
    scores = np.empty(len(out))
    scores[np.concatenate(lanes)] = out
    return scores


class TokenTable:
    """What is known of the most frequent tokens: output number and log10(count + 1); the rest go by their spelling."""

    def __init__(self, words: list[bytes], counts: dict[bytes, int]):
        self.n = len(words)
        number = {w: i for i, w in enumerate(words)}
        names = [*words, *(w for w in counts if w not in number)]
        self.names, self.end = pa.array(names, pa.binary()), number[END]
        self.number = np.array([number[w] if w in number else self.n + rare_class(w) for w in names], np.int32)
        #: -1: not counted at all (only the end token of an empty corpus)
        self.log = np.array([log10(counts[w] + 1) if w in counts else -1.0 for w in names])

    def look(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of all tokens of some texts: output numbers, log10(count + 1) (-1 where not in the table), the place after each
        text's last, and the tokens that are not in the table."""
        words, edge = split_words(texts)
        stop = edge[1:] + np.arange(1, len(texts) + 1)
        at = np.full(int(stop[-1]) if len(stop) else 0, self.end, np.int32)
        inner = np.ones(len(at), bool)
        inner[stop - 1] = False  # the end tokens
        at[inner] = pc.index_in(words, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        ids, log = self.number[at], self.log[at]
        far = np.nonzero(at < 0)[0]
        rest = words.filter(pa.array(at[inner] < 0))
        if len(far):
            ids[far] = rare_classes(rest) + self.n
            log[far] = -1.0
        return ids, log, stop, rest


def most_frequent(counts: DataFrame, most: int, above: int = 0, upto: int = KNOWN_BYTES) -> list[tuple[bytes, int]]:
    """At most ``most`` of the most frequent tokens of more than ``above`` and up to ``upto`` bytes, all of those at or above
    some count, most frequent first.

    The count is read off a histogram of a few hundred cells, so no task and no driver holds more than it keeps.
    """
    short = counts.filter((F.length("token") > above) & (F.length("token") <= upto))
    cell = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16) + 1000).cast("bigint")
    cells = short.groupBy(cell.alias("cell")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect()
    kept, least = 0, None
    for r in sorted(cells, key=lambda r: -r["least"]):
        if kept + r["tokens"] > most:
            break
        kept, least = kept + r["tokens"], r["least"]
    if least is None:
        return []
    rows = short.filter(F.col("n") >= least).collect()
    return sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def token_rows(texts: DataFrame, table: TokenTable, base_at: float, rare_at: list[float]) -> DataFrame:
    """(id, n_tokens, known, base, within, outputs, rare) per row of (id, t).

    ``outputs`` are the text's output numbers, 16 bits each; ``within`` what its tokens in the table have inside their
    rare classes; ``rare`` the tokens outside the table, whose counts come by a join.
    """
    sent = texts.sparkSession.sparkContext.broadcast((table, base_at, rare_at))
    schema = pa.schema(
        [("id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("within", pa.float64()),
         ("outputs", pa.binary()), ("rare", pa.list_(pa.binary()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base_at, rare_at = sent.value
        spent = np.concatenate([np.zeros(table.n), rare_at])
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, got, stop, far = table.look(batch.column(1))
                near, first = got >= 0, np.concatenate([[0], stop[:-1]])
                per = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023  # every text has its end token
                size = stop - first
                # inside a rare class: log10(c + 1) - log10(N_r + V_r + 1)
                within = np.where(near & (ids >= table.n), got, 0.0) - spent[ids]
                outputs, cut = ids.astype(np.uint16).tobytes(), (2 * np.concatenate([[0], stop])).tolist()
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per(~near & (ids >= table.n)))]), pa.int32()), far)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(size, pa.int64()), pa.array(per(near.astype(np.int64)), pa.int64()),
                        pa.array(per(np.where(near, got, 0.0)) - base_at * size), pa.array(per(within)),
                        pa.array([outputs[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()), rare,
                    ],
                    schema=schema,
                )

    return texts.select(F.col("id").cast("bigint").alias("id"), "t").mapInArrow(
        run, "id bigint, n_tokens bigint, known bigint, base double, within double, outputs binary, rare array<binary>"
    )


def averaged(rows: DataFrame, net: Net, start: int, rate: float) -> Net:
    """``net`` after one pass over ``rows`` (outputs binary): every partition trains a copy on all its rows, and the copies
    are averaged by their tokens, each of ``CHUNKS`` parts of the parameters in a task of its own, so that no task and no
    driver holds more than one network."""
    sent = rows.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("chunk", pa.int32()), ("n", pa.int64()), ("p", pa.binary())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        trainer = Trainer(own.unpacked(np.frombuffer(own.pack(), np.float32)), start, rate)
        held, size, seen = [], 0, 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(np.frombuffer(data, np.uint16))
                size += len(held[-1])
                if size >= TRAIN_TOKENS:
                    trainer.learn(np.concatenate(held))
                    held, size, seen = [], 0, seen + size
        if size:
            trainer.learn(np.concatenate(held))
        if seen + size:
            made = np.array_split(np.frombuffer(trainer.net.pack(), np.float32), CHUNKS)
            yield record_batch(schema, range(CHUNKS), [seen + size] * CHUNKS, [x.tobytes() for x in made])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple] = {}
        for batch in batches:
            for c, k, p in zip(*(x.to_pylist() for x in batch.columns)):
                n, total = sums.get(c, (0, 0.0))
                sums[c] = n + k, total + np.frombuffer(p, np.float32).astype(np.float64) * k
        if sums:
            yield record_batch(schema, list(sums), [n for n, _ in sums.values()], [(x / n).astype(np.float32).tobytes() for n, x in sums.values()])

    form = "chunk int, n bigint, p binary"
    made = rows.select("outputs").mapInArrow(learn, form).repartition(CHUNKS, "chunk").mapInArrow(add, form)
    found = sorted(made.collect(), key=lambda r: r["chunk"])  # the parts of one network
    return net.unpacked(np.concatenate([np.frombuffer(r["p"], np.float32) for r in found])) if found else net


def rounds_of(tokens: int, copy_tokens: int = COPY_TOKENS, trainers: int = TRAINERS) -> tuple[int, int]:
    """(rounds, copies): all tokens in that many equal parts, about ``copy_tokens`` each.

    Two rounds where there is more than one part, so that copies agree once before the end; more where ``trainers`` side by
    side don't suffice.
    """
    parts = max(1, -(-tokens // copy_tokens))
    rounds = max(min(2, parts), -(-parts // trainers))
    return rounds, -(-parts // rounds)


def dealt(rows: DataFrame, rounds: int, copies: int, k: int) -> DataFrame:
    """Round ``k``'s part of ``rows`` (row, outputs), a partition for each copy, in a fixed order: by a hash of the row's number."""
    h = F.pmod(F.xxhash64("row"), F.lit(rounds * copies))
    part = rows.select("outputs", F.xxhash64("row").alias("order"), h.alias("part")).filter(F.col("part") % rounds == k)
    return part.repartitionById(copies, (F.col("part") / rounds).cast("int")).sortWithinPartitions("order").select("outputs")


def score_texts(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: int = VOCAB, known: int = KNOWN,
    copy_tokens: int = COPY_TOKENS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Null and empty texts are one end token.  Null ids fold as the text 'null'.  Repeated rows give repeated rows and
    count as often as they occur.  With nothing to learn from every token is unknown.  Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    learn = texts.filter(bernoulli_fold("id", FOLDS) != HELD_OUT)
    counts = written(spark, token_counts(learn, "t"), "lm-counts")
    N, V = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, known)
    if END not in dict(top):  # the end token is always an output word
        end = counts.filter(F.col("token") == F.lit(END)).select("n").collect()
        top = [(END, r["n"]) for r in end[:1]] + top
    words = [w for w, _ in top[:vocab]]
    if END not in words:
        words = [END, *words[: vocab - 1]]
    top += most_frequent(counts, LONG_KNOWN, KNOWN_BYTES, LONG_BYTES)
    table = TokenTable(words, dict(top))
    totals = _rare_totals(counts, words)
    start = words.index(END)
    rare_at = [log10(sum(totals.get(k, (0, 0))) + 1) for k in range(RARE)]
    rows = token_rows(texts, table, log10(N + V + 1), rare_at).withColumn("row", F.monotonically_increasing_id())
    rows = written(spark, rows, "lm-rows")
    known_counts = dict(top)
    net = unigram_net(np.array([known_counts.get(w, 0) for w in words] + [totals.get(k, (0, 0))[0] for k in range(RARE)], np.float64))
    mine = rows.filter(bernoulli_fold("id", FOLDS) != HELD_OUT)
    rounds, copies = rounds_of(N, copy_tokens)
    for k in range(rounds):  # each round has its own part of the rows; together they are all
        net = averaged(dealt(mine, rounds, copies, k), net, start, RATE / (1 + k))
    sent = spark.sparkContext.broadcast(net)
    carried = ["row", "id", "n_tokens", "known", "base", "within"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, streams, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            model, at = stream_scores(sent.value, streams, start) * LOG10E, 0
            for part in held:
                yield pa.RecordBatch.from_arrays([*part, pa.array(model[at : at + len(part[0])])], names=[*carried, "model"])
                at += len(part[0])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                held.append(batch.columns[: len(carried)])
                streams += [np.frombuffer(x, np.uint16) for x in batch.column(len(carried)).to_pylist()]
                size += sum(map(len, streams[-batch.num_rows :]))
                if size >= SCORED_TOKENS:
                    yield from flush()
                    held, streams, size = [], [], 0
        if held:
            yield from flush()

    far = rows.select("row", F.explode("rare").alias("token")).join(counts.hint("shuffle_hash"), "token").groupBy("row").agg(
        F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain")
    )
    scored = rows.select(*carried, "outputs").mapInArrow(
        score, "row bigint, id bigint, n_tokens bigint, known bigint, base double, within double, model double"
    )
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.join(far, "row", "left").select(
        F.col("id").alias("doc_id"),
        (bernoulli_fold("id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(N).cast("bigint").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("model") + F.col("within") + gain).alias("score"),
    )


def _rare_totals(counts: DataFrame, words: list[bytes]) -> dict[int, tuple[int, int]]:
    """Rare class -> (tokens, distinct tokens) over all counts but the output words."""
    schema = pa.schema([("cls", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own = pa.array(words, pa.binary()), np.zeros((RARE, 2), np.int64)
        for batch in batches:
            rare = batch.filter(pc.invert(pc.is_in(batch.column(0), value_set=out)))
            at = rare_classes(rare.column(0))
            np.add.at(own[:, 0], at, rare.column(1).to_numpy())
            own[:, 1] += np.bincount(at, minlength=RARE)
        yield record_batch(schema, np.arange(RARE), own[:, 0], own[:, 1])

    rows = counts.mapInArrow(run, "cls int, n bigint, v bigint").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    return {r["cls"]: (r["n"], r["v"]) for r in rows}  # RARE rows
