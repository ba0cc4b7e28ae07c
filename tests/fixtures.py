"""Small signals for the tests."""

import math
import random


def tone(seconds, level_db=0.0, rate=16000, hz=440):
    return [10 ** (level_db / 20) * math.sin(2 * math.pi * hz * i / rate)
            for i in range(int(seconds * rate))]


def bursts(spans, total_s, rate=16000):
    """Tones of 200 Hz inside the (start, end, level) spans, zero outside."""
    x = [0.0] * int(total_s * rate)
    for start, end, level in spans:
        for i in range(int(start * rate), min(int(end * rate), len(x))):
            x[i] = 10 ** (level / 20) * math.sin(2 * math.pi * 200 * (i - int(start * rate)) / rate)
    return x


def noisy_sessions(seed, sizes):
    """{(session, track): samples} with loud and quiet stretches of random length."""
    rnd = random.Random(seed)
    out = {}
    for key, size in sizes.items():
        x = []
        while len(x) < size:
            level = rnd.choice([0.002, 0.02, 0.05, 0.3])
            x += [level * rnd.uniform(-1, 1) for _ in range(rnd.randint(1, 40))]
        out[key] = x[:size]
    return out


def as_samples(spark, tracks):
    rows = [(s, t, i, float(v)) for (s, t), x in tracks.items() for i, v in enumerate(x)]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, "session_id long, track int, idx long, x double")


def as_segments(spark, lists):
    """{session: [(start, end, state)]} as a segment list."""
    rows = [(s, i * 3, float(a), float(b), 0, state, None)
            for s, items in lists.items() for i, (a, b, state) in enumerate(items)]
    return spark.createDataFrame(rows, "session_id long, pos long, start_s double, end_s double,"
                                       " camera_index int, speaker_state string,"
                                       " speaker_label string")


def listed(df):
    """{session: [(start, end, state)]} in order."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.start_s, r.pos)):
        out.setdefault(r.session_id, []).append((r.start_s, r.end_s, r.speaker_state))
    return out
