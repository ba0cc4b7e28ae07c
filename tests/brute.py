"""The definitions, one value after the other, for small fixtures."""

import math

FULL, QUIET = 0.0, -200.0


def rms_db(x, window, hop):
    starts = range(0, len(x) - window + 1, hop)
    return [20 * math.log10(math.sqrt(sum(v * v for v in x[s:s + window]) / window) + 1e-10)
            for s in starts]


def ema(levels, kernel):
    weight, out = 2 / (kernel + 1), []
    for level in levels:
        out.append(level if not out else weight * level + (1 - weight) * out[-1])
    return out


def flags(envelope, up, down, hangover):
    out, on, waited = [], False, None
    for level in envelope:
        if not on:
            on = level > up
        elif waited is None:
            waited = 0 if level < down else None
        elif level > up:
            waited = None
        else:
            waited += 1
            on = waited <= hangover
            waited = waited if on else None
        out.append(on)
    return out


def joint(a, b):
    names = {(True, True): "both", (True, False): "speaker_a",
             (False, True): "speaker_b", (False, False): "silence"}
    return [names[pair] for pair in zip(a, b)]


def runs(states, hop_s):
    edges = [i for i, s in enumerate(states) if i == 0 or s != states[i - 1]]
    return [(i * hop_s, j * hop_s, states[i])
            for i, j in zip(edges, [*edges[1:], len(states)])]


def absorb(segments, min_s):
    out = []
    for start, end, state in segments:
        if out and end - start < min_s:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            out.append((start, end, state))
    return out


def merge(segments):
    out = []
    for start, end, state in segments:
        if out and out[-1][2] == state:
            out[-1] = (out[-1][0], end, state)
        else:
            out.append((start, end, state))
    return out


def clean(segments, p):
    return merge(absorb(absorb(segments, p.grid.debounce_s), p.grid.min_segment_s))


def track_flags(x, p):
    levels = ema(rms_db(x, p.grid.window, p.grid.hop), p.grid.kernel)
    return flags(levels, p.speech_threshold_db, p.release_threshold_db, p.grid.hangover)


def session_segments(a, b, p):
    size = max(len(a), len(b))
    a, b = (list(t) + [0.0] * (size - len(t)) for t in (a, b))
    return clean(runs(joint(track_flags(a, p), track_flags(b, p)), p.grid.hop_s), p)
