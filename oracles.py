"""The same answers as the registered queries, as SQL in another form.

The SQL follows the definitions step by step: sample-in-window joins,
recursive smoothing and state machines, islands by running counts.
"""

from __future__ import annotations

from catalog import (CROSSED_PARAMS, EVENT_PARAMS, FPS, LINE_ORDER, LINE_PARAMS, PANE_PARAMS,
                     RATES, TURN_PARAMS, TURN_STRIDE, UNEVEN_PARAMS)


def _d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _with(ctes: list[str], query: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + query


# ---- samples ----

_EVENT_TRACK = "CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END"


def _samples(table: str, session: str, track: str, order: list[str], value: str) -> str:
    return f"""samples AS MATERIALIZED (
  SELECT session_id, track, row_number() OVER (PARTITION BY session_id, track
         ORDER BY {', '.join(order)}) - 1 AS idx, x
  FROM (SELECT *, {session} AS session_id, {track} AS track, {value} AS x FROM {table}))"""


_EVENTS = _samples("events", "user_id", _EVENT_TRACK, ["ts", "event_id"], f"value / {_d(600.0)}")


def _lines(session: str) -> str:
    return _samples("lineitem", session, "CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END",
                    LINE_ORDER, f"l_extendedprice / {_d(105000.0)}")


_VECTORS = """samples AS MATERIALIZED (
  SELECT vec_id // 2 AS session_id, CAST(vec_id % 2 AS INTEGER) AS track, p - 1 AS idx,
         CAST(embedding[p] AS DOUBLE) AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))"""

_PADDED = """padded AS MATERIALIZED (
  SELECT g.session_id, g.track, g.idx, coalesce(s.x, CAST(0 AS DOUBLE)) AS x
  FROM (SELECT session_id, track, unnest(range(0, longest)) AS idx
        FROM (SELECT session_id, max(idx) + 1 AS longest FROM samples GROUP BY session_id),
             (VALUES (0), (1)) AS t(track)) g
  LEFT JOIN samples s USING (session_id, track, idx))"""

_PAD_PRESENT = """present AS (SELECT DISTINCT session_id, track FROM samples)"""


# ---- frames ----

def _rms(source: str, window: int, hop: int) -> str:
    return f"""rms AS MATERIALIZED (
  SELECT w.session_id, w.track, w.frame,
         20 * log10(sqrt(avg(s.x * s.x)) + CAST(1e-10 AS DOUBLE)) AS rms_db
  FROM (SELECT session_id, track, frame, frame * {hop} + unnest(range(0, {window})) AS idx
        FROM (SELECT session_id, track, unnest(range(0, (n - {window}) // {hop} + 1)) AS frame
              FROM (SELECT session_id, track, count(*) AS n FROM {source} GROUP BY ALL)
              WHERE n >= {window})) w
  JOIN {source} s USING (session_id, track, idx)
  GROUP BY w.session_id, w.track, w.frame)"""


def _ema(kernel: int) -> str:
    alpha = 2.0 / (kernel + 1)
    return f"""ema AS (
  SELECT session_id, track, frame, rms_db, rms_db AS env FROM rms WHERE frame = 0
  UNION ALL
  SELECT r.session_id, r.track, r.frame, r.rms_db,
         {_d(alpha)} * r.rms_db + (1 - {_d(alpha)}) * e.env
  FROM ema e JOIN rms r ON r.session_id = e.session_id AND r.track = e.track
                       AND r.frame = e.frame + 1)"""


def _flags(p) -> str:
    up = f"e.env > {_d(p.speech_threshold_db)}"
    down = f"e.env < {_d(p.release_threshold_db)}"
    limit = p.grid.hangover
    return f"""flags AS (
  SELECT e.session_id, e.track, e.frame, CASE WHEN {up} THEN 1 ELSE 0 END AS st, 0 AS waited,
         {up} AS is_active FROM ema e WHERE e.frame = 0
  UNION ALL
  SELECT e.session_id, e.track, e.frame,
         CASE f.st WHEN 0 THEN CASE WHEN {up} THEN 1 ELSE 0 END
                   WHEN 1 THEN CASE WHEN {down} THEN 2 ELSE 1 END
                   ELSE CASE WHEN {up} THEN 1 WHEN f.waited >= {limit} THEN 0 ELSE 2 END END,
         CASE WHEN f.st = 2 AND NOT {up} AND f.waited < {limit} THEN f.waited + 1 ELSE 0 END,
         f.st = 1 OR {up} OR (f.st = 2 AND f.waited < {limit})
  FROM flags f JOIN ema e ON e.session_id = f.session_id AND e.track = f.track
                         AND e.frame = f.frame + 1)"""


def _convolved(kernel: int, reach: int = 200) -> str:
    """Smoothing without recursion: what lies `reach` frames back weighs nothing."""
    alpha = 2.0 / (kernel + 1)
    return f"""ema AS MATERIALIZED (
  SELECT f.session_id, f.track, f.frame,
         sum(CASE WHEN r.frame = 0 THEN CAST(1 AS DOUBLE) ELSE {_d(alpha)} END * r.rms_db
             * pow({_d(1 - alpha)}, f.frame - r.frame)) AS env
  FROM (SELECT session_id, track, frame, unnest(range(greatest(0, frame - {reach}), frame + 1)) AS k
        FROM rms) f
  JOIN rms r ON r.session_id = f.session_id AND r.track = f.track AND r.frame = f.k
  GROUP BY f.session_id, f.track, f.frame)"""


def _counted_flags(p) -> str:
    """Flags from the last loud frame and the first quiet one after it."""
    up = f"env > {_d(p.speech_threshold_db)}"
    down = f"env < {_d(p.release_threshold_db)}"
    return f"""heard AS (
  SELECT *, max(CASE WHEN {up} THEN frame END) OVER (
    PARTITION BY session_id, track ORDER BY frame) AS loud FROM ema),
flags AS MATERIALIZED (
  SELECT *, loud IS NOT NULL AND (quiet IS NULL OR frame - quiet <= {p.grid.hangover}) AS is_active
  FROM (SELECT *, min(CASE WHEN {down} THEN frame END) OVER (
    PARTITION BY session_id, track, loud ORDER BY frame) AS quiet FROM heard))"""


_STATES = """states AS MATERIALIZED (
  SELECT a.session_id, a.frame,
         CASE WHEN a.is_active AND b.is_active THEN 'both' WHEN a.is_active THEN 'speaker_a'
              WHEN b.is_active THEN 'speaker_b' ELSE 'silence' END AS speaker_state
  FROM flags a JOIN flags b ON b.session_id = a.session_id AND b.frame = a.frame
  WHERE a.track = 0 AND b.track = 1)"""


# ---- segments ----

def _runs(hop_s: float) -> str:
    h = _d(hop_s)
    return f"""runs AS (
  SELECT session_id, min(frame) AS pos, min(frame) * {h} AS start_s,
         (max(frame) + 1) * {h} AS end_s, min(speaker_state) AS speaker_state
  FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, speaker_state
                                             ORDER BY frame) AS island FROM states)
  GROUP BY session_id, speaker_state, island)"""


def _islands(name: str, source: str, head: str) -> str:
    """Rows with `head` start a group; the group keeps its first row's state."""
    return f"""{name} AS (
  SELECT session_id, min(pos) AS pos, min(start_s) AS start_s, max(end_s) AS end_s,
         arg_min(speaker_state, pos) AS speaker_state
  FROM (SELECT *, sum(head) OVER (PARTITION BY session_id ORDER BY pos) AS island
        FROM (SELECT *, CASE WHEN {head} THEN 1 ELSE 0 END AS head FROM {source}
              WINDOW w AS (PARTITION BY session_id ORDER BY pos)))
  GROUP BY session_id, island)"""


def _absorb(name: str, source: str, min_s: float) -> str:
    return _islands(name, source,
                    f"row_number() OVER w = 1 OR NOT (end_s - start_s < {_d(min_s)})")


def _merge(name: str, source: str) -> str:
    return _islands(name, source,
                    "lag(speaker_state) OVER w IS DISTINCT FROM speaker_state")


def _clean(source: str, p) -> list[str]:
    return [_absorb("debounced", source, p.grid.debounce_s),
            _absorb("lengthened", "debounced", p.grid.min_segment_s), _merge("merged", "lengthened")]


_NUMBERED = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS seg_idx FROM merged)"""


def _seconds(source: str) -> str:
    return f"""SELECT session_id, pos, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s,
       speaker_state FROM {source}"""


_SEG = """SELECT session_id, seg_idx, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s,
       speaker_state FROM numbered"""

_FRAMES = [_EVENTS, _rms("samples", 3, 1), _ema(EVENT_PARAMS.grid.kernel)]
_FLAGS = [*_FRAMES, _flags(EVENT_PARAMS)]
_EVENT_RUNS = [*_FLAGS, _STATES, _runs(EVENT_PARAMS.grid.hop_s)]
_PAD_FLAGS = [_EVENTS, _PADDED, _rms("padded", 3, 1), _ema(EVENT_PARAMS.grid.kernel),
              _flags(EVENT_PARAMS)]


def _line_segments(session: str) -> list[str]:
    return [_lines(session), _PADDED, _rms("padded", 3, 1), _convolved(LINE_PARAMS.grid.kernel),
            _counted_flags(LINE_PARAMS), _STATES, _runs(LINE_PARAMS.grid.hop_s),
            *_clean("runs", LINE_PARAMS), _NUMBERED]


_WAV = """samples AS MATERIALIZED (
  SELECT g // 2 AS session_id, CAST(g % 2 AS INTEGER) AS track, idx,
         avg(floor(v * 32768) / CAST(32768 AS DOUBLE)) AS x
  FROM (SELECT g, (vec_id % 8 - opens) * 32 + p // 2 AS idx, CAST(embedding[p + 1] AS DOUBLE) AS v
        FROM (SELECT *, unnest(range(0, len(embedding))) AS p
              FROM (SELECT *, vec_id // 8 AS g,
                           min(vec_id % 8) OVER (PARTITION BY vec_id // 8) AS opens FROM embeddings)))
  GROUP BY ALL)"""


def _resampled(from_rate: int | str, to_rate: int, samples: str = _VECTORS) -> str:
    return _with([samples], f"""SELECT o.session_id, o.track, o.j AS idx,
       round(a.x + (o.at - o.i) * (coalesce(b.x, a.x) - a.x), 6) AS x
FROM (SELECT *, CAST(j AS DOUBLE) * n / n_out AS at, j * n // n_out AS i
      FROM (SELECT *, unnest(range(0, n_out)) AS j
            FROM (SELECT session_id, track, count(*) AS n,
                         CASE WHEN {from_rate} = {to_rate} THEN count(*) ELSE CAST(floor(
                    CAST(count(*) AS DOUBLE) / {from_rate} * {to_rate}) AS BIGINT) END AS n_out
                  FROM samples GROUP BY session_id, track))) o
JOIN samples a ON a.session_id = o.session_id AND a.track = o.track AND a.idx = o.i
LEFT JOIN samples b ON b.session_id = o.session_id AND b.track = o.track AND b.idx = o.i + 1""")


# ---- conversations ----

_FPS = "[" + ", ".join(_d(f) for f in FPS) + f"][session_id % {len(FPS)} + 1]"

def _turns(session: str = "conv_id", pos: str = "turn") -> str:
    return f"""turns AS (
  SELECT session_id, pos, speaker_state, (till - chars) / {_d(15.0)} AS start_s,
         till / {_d(15.0)} AS end_s
  FROM (SELECT {session} AS session_id, {pos} AS pos, length(text) AS chars,
               CASE role WHEN 'user' THEN 'speaker_a' WHEN 'assistant' THEN 'speaker_b'
                         ELSE 'silence' END AS speaker_state,
               sum(length(text)) OVER (PARTITION BY {session} ORDER BY {pos}) AS till
        FROM conversations))"""


def _durations(session: str = "conv_id") -> str:
    return f"""durations AS (
  SELECT session_id, total_duration_s, {_FPS} AS fps
  FROM (SELECT {session} AS session_id, sum(length(text)) / {_d(15.0)} AS total_duration_s
        FROM conversations GROUP BY {session}))"""


_TURNS, _DURATIONS = _turns(), _durations()
_ONE, _ONE_POS = "CAST(1 AS BIGINT)", f"conv_id * {TURN_STRIDE} + turn"
_TURN_SEGMENTS = [_TURNS, *_clean("turns", TURN_PARAMS), _NUMBERED]

_PLAN = f"""plan AS (
  SELECT *, session_id % 5 <> 0 AS described,
         CASE speaker_state WHEN 'speaker_a' THEN 1 WHEN 'speaker_b' THEN 2 ELSE 0 END
           AS camera_index,
         CASE WHEN speaker_state NOT IN ('speaker_a', 'speaker_b') THEN NULL
              WHEN session_id % 5 = 0 THEN speaker_state
              WHEN speaker_state = 'speaker_b' THEN 'guest'
              WHEN session_id % 7 = 0 THEN '' ELSE 'host & ' || session_id END AS speaker_label
  FROM numbered)"""

_EVENTS_OF = f"""gains AS (
  SELECT session_id, seg_idx, start_s AS time_s,
         CASE WHEN speaker_state = other THEN {_d(TURN_PARAMS.ducking_db)}
              ELSE CAST(0 AS DOUBLE) END AS target_db, track_index
  FROM numbered, (VALUES (0, 'speaker_b'), (1, 'speaker_a')) AS t(track_index, other))"""

_TIMELINE = [*_TURN_SEGMENTS, _PLAN, _DURATIONS, _EVENTS_OF]
_LONG = [_turns(_ONE, _ONE_POS), *_clean("turns", TURN_PARAMS), _NUMBERED, _PLAN,
         _durations(_ONE), _EVENTS_OF]


def _frame(seconds: str) -> str:
    return f"CAST(round_even({seconds} * fps, 0) AS BIGINT)"


_CLIPS = f"""clips AS (
  SELECT session_id, seg_idx, fps, 'clipitem-v' || seg_idx AS clip_id,
         'Cam' || cam || ' - ' || speaker_state AS name, CAST(cam AS INTEGER) AS camera_index,
         {_frame('start_s')} AS start_frame, {_frame('end_s')} AS end_frame,
         {_frame('end_s')} - {_frame('start_s')} AS duration_frames, 'file-cam' || cam AS file_id,
         '/cam/' || session_id || '/' || ['wide & all', 'host', 'guest'][cam + 1] || '.mp4' AS path,
         {_frame('total_duration_s')} AS file_frames
  FROM (SELECT *, CASE WHEN camera_index = 2 AND session_id % 4 = 0 THEN 0
                       ELSE camera_index END AS cam FROM plan) JOIN durations USING (session_id)),
used AS (SELECT *, row_number() OVER (PARTITION BY session_id, file_id ORDER BY seg_idx) = 1
                AS is_definition FROM clips)"""

_AUDIO = f"""audio AS (
  SELECT session_id, track, fps, 'clipitem-a' || track AS clip_id,
         CASE track WHEN 0 THEN 'host ~*é.take' ELSE '<guest>' END AS name,
         CAST(0 AS BIGINT) AS start_frame, {_frame('total_duration_s')} AS end_frame,
         'file-audio' || track AS file_id,
         CASE track WHEN 0 THEN '/mic/' || session_id || '/host ~*é.take.wav'
                    ELSE '/mic//' || session_id || '/./<guest>' END AS path
  FROM durations, (VALUES (0), (1)) AS t(track) WHERE session_id % 5 <> 0)"""

_KEYS = f"""keys AS (
  SELECT session_id, seg_idx, track_index AS track, {_frame('time_s')} AS frame,
         printf('%.4f', pow(CAST(10 AS DOUBLE), target_db / 20)) AS gain
  FROM gains JOIN durations USING (session_id))"""

_FLAT = """SELECT session_id, seg_idx, round(total_duration_s, 6) AS total_duration_s, fps,
       round(start_s, 6) AS start_s, round(end_s, 6) AS end_s,
       CAST(camera_index AS INTEGER) AS camera_index, speaker_state, speaker_label
FROM plan JOIN durations USING (session_id)"""


# ---- documents as text ----

def _leaf(depth: int, name: str, value: str) -> str:
    return f"'{'  ' * depth}<{name}>' || {value} || '</{name}>' || chr(10)"


def _lines_of(*lines: str) -> str:
    return "'" + "' || chr(10) || '".join(line.replace("'", "''") for line in lines) \
        + "' || chr(10)"


def _rate(depth: int) -> str:
    base = """CASE WHEN abs(fps - 29.97) < 0.1 THEN 30 WHEN abs(fps - 23.976) < 0.1 THEN 24
                   ELSE CAST(round_even(fps, 0) AS INTEGER) END"""
    drop = "CASE WHEN abs(fps - 29.97) < 0.1 OR abs(fps - 23.976) < 0.1 THEN 'TRUE' ELSE 'FALSE' END"
    i = "  " * depth
    return (f"'{i}<rate>' || chr(10) || {_leaf(depth + 1, 'timebase', f'({base})')} || "
            f"{_leaf(depth + 1, 'ntsc', f'({drop})')} || '{i}</rate>' || chr(10)")


def _file(media: str, frames: str, name: str) -> str:
    i = "            "
    return (f"'{i}<file id=\"' || file_id || '\">' || chr(10) || {_leaf(7, 'name', name)} || "
            f"{_leaf(7, 'pathurl', 'uri')} || {_rate(7)} || {_leaf(7, 'duration', frames)} || "
            f"{_lines_of(i + '  <media>', i + f'    <{media}>')} || "
            f"{_leaf(9, 'duration', frames)} || "
            f"{_lines_of(i + f'    </{media}>', i + '  </media>', i + '</file>')}")


def _clip(frames: str, start: str, end: str, name: str) -> str:
    return (f"'          <clipitem id=\"' || clip_id || '\">' || chr(10) || {_leaf(6, 'name', name)}"
            f" || {_leaf(6, 'duration', frames)} || {_rate(6)} || {_leaf(6, 'start', start)}"
            f" || {_leaf(6, 'end', end)} || {_leaf(6, 'in', start)} || {_leaf(6, 'out', end)}")


def _xml_sql(title: str, with_audio: bool, timeline: list[str] = _TIMELINE) -> str:
    head = " || ".join([
        _lines_of("<?xml version='1.0' encoding='utf-8'?>", '<xmeml version="5">', "  <sequence>"),
        _leaf(2, "name", f"'{title}'"), _leaf(2, "duration", _frame("total_duration_s")), _rate(2),
        _lines_of("    <timecode>"), _rate(3), _leaf(3, "string", "'01:00:00:00'"),
        _leaf(3, "frame", _frame("3600")), _leaf(3, "displayformat", "'NDF'"),
        _lines_of("    </timecode>", "    <media>", "      <video>", "        <format>",
                  "          <samplecharacteristics>", "            <width>1920</width>",
                  "            <height>1080</height>",
                  "            <pixelaspectratio>Square</pixelaspectratio>"), _rate(6),
        _lines_of("          </samplecharacteristics>", "        </format>", "        <track>",
                  "          <enabled>TRUE</enabled>", "          <locked>FALSE</locked>")])
    name = "replace(split_part(path, '/', -1), '&', '&amp;')"
    video = (_clip("duration_frames", "start_frame", "end_frame", "name") + " || CASE WHEN "
             "is_definition THEN " + _file("video", "file_frames", name)
             + " ELSE '            <file id=\"' || file_id || '\" />' || chr(10) END || "
             + _lines_of("          </clipitem>"))
    audio_name = "replace(replace({}, '<', '&lt;'), '>', '&gt;')"
    audio = (_lines_of("        <track>", "          <enabled>TRUE</enabled>",
                       "          <locked>FALSE</locked>") + " || "
             + _clip("end_frame", "start_frame", "end_frame", audio_name.format("name")) + " || "
             + _file("audio", "end_frame", audio_name.format("split_part(path, '/', -1)")))
    filter_head = _lines_of(
        "            <filter>", "              <effect>",
        "                <name>Audio Levels</name>",
        "                <effectid>audiolevels</effectid>",
        "                <effecttype>audio</effecttype>",
        "                <parameter>", "                  <parameterid>level</parameterid>",
        "                  <name>Level</name>")
    filter_end = _lines_of("                </parameter>", "              </effect>",
                           "            </filter>")
    key = (_lines_of("                  <keyframe>") + " || " + _leaf(10, "when", "frame") + " || "
           + _leaf(10, "value", "gain") + " || " + _lines_of("                  </keyframe>"))
    audio_head = _lines_of(
        "      <audio>", "        <format>", "          <samplecharacteristics>",
        "            <depth>16</depth>", "            <samplerate>48000</samplerate>",
        "          </samplecharacteristics>", "        </format>", "        <outputs>",
        "          <group>", "            <index>1</index>",
        "            <numchannels>2</numchannels>", "            <downmix>0</downmix>",
        "            <channel>", "              <index>1</index>", "            </channel>",
        "          </group>", "        </outputs>")
    ctes = [
        *timeline, _CLIPS, _AUDIO, _KEYS,
        "camera_uris AS (SELECT *, 'file://' || replace(url_encode(path), '%2F', '/') AS uri"
        " FROM used)",
        "mic_uris AS (SELECT *, 'file://' || replace(url_encode("
        "replace(replace(path, '//', '/'), '/./', '/')), '%2F', '/') AS uri FROM audio)",]
    def rows(section: str, place: str, text: str, source: str) -> str:
        return (f"SELECT session_id, CAST({section} AS INTEGER) AS section,"
                f" CAST({place} AS BIGINT) AS place, rtrim({text}, chr(10)) AS text FROM {source}")

    found = [rows("0", "0", head, "durations"), rows("1", "seg_idx", video, "camera_uris"),
             rows("2", "0", _lines_of("        </track>", "      </video>"), "durations"),
             rows("15", "0", _lines_of("    </media>", "  </sequence>") + " || '</xmeml>'",
                  "durations")]
    if with_audio:
        # every session of these queries has gain events, unless it has no segment
        filtered = "mic_uris SEMI JOIN keys USING (session_id, track)"
        found += [rows("3", "0", audio_head, "mic_uris WHERE track = 0"),
                  rows("4 + 5 * track", "0", audio, "mic_uris"),
                  rows("5 + 5 * track", "0", filter_head, filtered),
                  rows("6 + 5 * track", "2 * seg_idx + track", key,
                       "keys SEMI JOIN mic_uris USING (session_id, track)"),
                  rows("7 + 5 * track", "0", filter_end, filtered),
                  rows("8 + 5 * track", "0",
                       _lines_of("          </clipitem>", "        </track>"), "mic_uris"),
                  rows("14", "0", _lines_of("      </audio>"), "mic_uris WHERE track = 0")]
    return _with(ctes, " UNION ALL ".join(found))


def oracle_sql() -> dict[str, str]:
    line = "printf('  %3d  %7.2fs - %7.2fs  [cam%d]  %-12s  %s', "
    return {
        "track_index": _with([_EVENTS], "SELECT session_id, track, idx, round(x, 6) AS x"
                                        " FROM samples"),
        "array_samples": _with([_VECTORS], "SELECT session_id, track, idx, round(x, 6) AS x"
                                           " FROM samples"),
        "chunked_samples": """SELECT CAST(label AS BIGINT) AS session_id, 0 AS track,
  row_number() OVER (PARTITION BY label ORDER BY vec_id, p) - 1 AS idx,
  round(CAST(embedding[p] AS DOUBLE), 6) AS x
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)""",
        "wav_samples": """SELECT vec_id // 8 AS session_id, 0 AS track,
  (vec_id % 8 - (SELECT min(m.vec_id % 8) FROM embeddings m
                 WHERE m.vec_id // 8 = e.vec_id // 8)) * 32 + p // 2 AS idx,
  round(avg(floor(CAST(embedding[p + 1] AS DOUBLE) * 32768) / CAST(32768 AS DOUBLE)), 6) AS x
FROM (SELECT *, unnest(range(0, len(embedding))) AS p FROM embeddings) e GROUP BY ALL""",
        "mono_mixdown": """SELECT vec_id, round(avg(CAST(x AS DOUBLE)), 6) AS x
FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id""",
        "mono_mixdown_rows": _with([_EVENTS], "SELECT session_id, 0 AS track, idx,"
                                   " round(avg(x), 6) AS x FROM samples GROUP BY session_id, idx"),
        "resample_linear": _resampled(44_100, 16_000),
        "resample_up": _resampled(16_000, 44_100),
        "wav_ingest": _resampled(f"{list(RATES)}[(session_id * 2 + track) % 3 + 1]", 16_000, _WAV),
        "align_pad": _with([_EVENTS, _PADDED, _PAD_PRESENT], "SELECT session_id, track, idx,"
                           " round(x, 6) AS x FROM padded SEMI JOIN present"
                           " USING (session_id, track)"),
        "session_duration": f"""SELECT session_id, round(max(n) / {_d(100.0)}, 6)
  AS total_duration_s FROM (SELECT user_id AS session_id, {_EVENT_TRACK} AS track, count(*) AS n
  FROM events GROUP BY ALL) GROUP BY session_id""",
        "frame_rms": _with([_EVENTS, _rms("samples", 3, 1)], "SELECT session_id, track, frame,"
                           " round(rms_db, 6) AS rms_db FROM rms"),
        "frame_rms_panes": _with(
            [_lines("l_suppkey"),
             _rms("samples", PANE_PARAMS.grid.window, PANE_PARAMS.grid.hop)],
            "SELECT session_id, track, frame, round(rms_db, 6) AS rms_db FROM rms"),
        "frame_rms_uneven": _with(
            [_lines("l_suppkey % 3"),
             _rms("samples", UNEVEN_PARAMS.grid.window, UNEVEN_PARAMS.grid.hop)],
            "SELECT session_id, track, frame, round(rms_db, 6) AS rms_db FROM rms"),
        "ema_envelope": _with(_FRAMES, "SELECT session_id, track, frame,"
                              " round(env, 6) AS envelope_db FROM ema"),
        "frame_table": _with(_FRAMES, f"""SELECT session_id, track, frame,
  round(frame * {_d(0.01)}, 6) AS time_s, round(rms_db, 6) AS rms_db,
  round(env, 6) AS envelope_db, false AS is_active FROM ema"""),
        "frame_dataset": _with(_FRAMES, f"""SELECT session_id, track, frame,
  round(frame * {_d(0.01)}, 6) AS time_s, round(rms_db, 6) AS rms_db,
  round(env, 6) AS envelope_db, false AS is_active FROM ema"""),
        "activity_flag": _with(_FLAGS, "SELECT session_id, track, frame, is_active FROM flags"),
        "activity_flag_crossed": _with([*_FRAMES, _flags(CROSSED_PARAMS)],
                                       "SELECT session_id, track, frame, is_active FROM flags"),
        "speaker_states": _with([*_FLAGS, _STATES], "SELECT * FROM states"),
        "joint_states": _with([*_PAD_FLAGS, _STATES], "SELECT * FROM states"),
        "runs": _with(_EVENT_RUNS, _seconds("runs")),
        "debounced": _with([*_EVENT_RUNS, *_clean("runs", EVENT_PARAMS)], _seconds("debounced")),
        "min_length": _with([*_EVENT_RUNS, *_clean("runs", EVENT_PARAMS)], _seconds("lengthened")),
        "merged": _with([*_EVENT_RUNS, *_clean("runs", EVENT_PARAMS)], _seconds("merged")),
        "merge_runs": _with([*_EVENT_RUNS, *_clean("runs", EVENT_PARAMS),
                             _merge("joined", "debounced")], _seconds("joined")),
        "event_segments": _with([*_PAD_FLAGS, _STATES, _runs(EVENT_PARAMS.grid.hop_s),
                                 *_clean("runs", EVENT_PARAMS), _NUMBERED], _SEG),
        "segments_lineitem": _with(_line_segments("l_suppkey"), _SEG),
        "segments_hot_session": _with(_line_segments(
            "CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END"), _SEG),
        "segments_hot_slices": _with(_line_segments(
            "CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END"), _SEG),
        **dict.fromkeys(("timelines_lineitem", "timelines_stored_panes"), _with(
            _line_segments("l_suppkey"), f"""SELECT session_id,
  round(total_duration_s, 6) AS total_duration_s, {_d(29.97)} AS fps,
  coalesce(n_segments, 0) AS n_segments, CAST(0 AS BIGINT) AS n_ducking_events
FROM (SELECT session_id, (max(idx) + 1) / {_d(100.0)} AS total_duration_s
      FROM samples GROUP BY session_id)
LEFT JOIN (SELECT session_id, count(*) AS n_segments FROM numbered GROUP BY session_id)
USING (session_id)""")),
        "turn_segments": _with(_TURN_SEGMENTS, _seconds("merged")),
        "segment_durations": _with([_TURNS], "SELECT session_id, pos,"
                                   " round(end_s - start_s, 6) AS duration_s FROM turns"),
        "camera_plan": _with([*_TURN_SEGMENTS, _PLAN], """SELECT session_id, seg_idx,
  round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, speaker_state,
  CAST(camera_index AS INTEGER) AS camera_index, speaker_label FROM plan"""),
        "gain_events": _with([*_TURN_SEGMENTS, _EVENTS_OF], "SELECT session_id, seg_idx,"
                             " round(time_s, 6) AS time_s, target_db, track_index FROM gains"),
        "timeline_counts": _with(_TIMELINE, """SELECT session_id,
  round(any_value(total_duration_s), 6) AS total_duration_s, any_value(fps) AS fps,
  CAST(count(*) AS INTEGER) AS n_segments, CAST(2 * count(*) AS INTEGER) AS n_events,
  arg_min(speaker_state, seg_idx) AS first_state
FROM plan JOIN durations USING (session_id) GROUP BY session_id"""),
        "frame_numbers": _with([_TURNS, _DURATIONS], f"""SELECT session_id, pos,
  {_frame('start_s')} AS start_frame, {_frame('end_s')} AS end_frame
FROM turns JOIN durations USING (session_id)"""),
        "rate_class": _with([_DURATIONS], """SELECT session_id, fps,
  CASE WHEN fps = CAST(23.976 AS DOUBLE) OR fps = 24 THEN 24
       WHEN fps = 25 THEN 25 WHEN fps > 50 THEN 60 ELSE 30 END AS timebase,
  CASE WHEN fps = 25 OR fps > 50 THEN 'FALSE' ELSE 'TRUE' END AS ntsc FROM durations"""),
        "start_timecode": _with([_DURATIONS], f"""SELECT session_id, '01:00:00:00' AS timecode,
  {_frame('3600')} AS frame, 'NDF' AS displayformat FROM durations"""),
        "file_uris": """SELECT page_id, 'file://' || replace(url_encode(path), '%2F', '/') AS uri,
  split_part(path, '/', -1) AS name,
  regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]+$', '\\1') AS stem
FROM (SELECT page_id, rtrim(replace('/media/ü *~/' || url, '//', '/'), '/') AS path FROM pages)""",
        "video_clips": _with([*_TIMELINE, _CLIPS], "SELECT * FROM clips"),
        "file_first_use": _with([*_TIMELINE, _CLIPS], "SELECT session_id, seg_idx, file_id,"
                                " is_definition FROM used"),
        "audio_clips": _with([_DURATIONS, _AUDIO], "SELECT * FROM audio"),
        "keyframes": _with([*_TIMELINE, _KEYS], "SELECT session_id, track, frame, gain FROM keys"),
        "timeline_json_roundtrip": _with(_TIMELINE, _FLAT),
        "timeline_files": _with(_TIMELINE, _FLAT),
        "long_session_json": _with(_LONG, _FLAT),
        "timeline_parts": _with(_TIMELINE, _FLAT),
        "timeline_event_rows": _with(_TIMELINE, "SELECT session_id, round(time_s, 6) AS time_s,"
                                     " target_db, track_index FROM gains"),
        "timeline_summary": _with(_TIMELINE, """SELECT session_id,
  round(any_value(total_duration_s), 6) AS total_duration_s, any_value(fps) AS fps,
  count(*) AS n_segments, 2 * count(*) AS n_ducking_events,
  printf('Duration: %.1fs | FPS: %s | Segments: %d', any_value(total_duration_s),
         CAST(any_value(fps) AS VARCHAR), count(*)) AS header,
  'Ducking events: ' || (2 * count(*)) AS footer
FROM plan JOIN durations USING (session_id) GROUP BY session_id"""),
        "segment_report": _with(_TIMELINE, f"""SELECT session_id, number,
  round(start_s, 6) AS start_s, round(end_s, 6) AS end_s,
  CAST(camera_index AS INTEGER) AS camera_index, label, bar,
  {line}number, start_s, end_s, camera_index, label, bar) AS line
FROM (SELECT session_id, seg_idx + 1 AS number, start_s, end_s, camera_index,
             CASE WHEN coalesce(speaker_label, '') = '' THEN speaker_state
                  ELSE speaker_label END AS label,
             repeat('#', greatest(1, CAST(floor((end_s - start_s) / total_duration_s * 50)
                                          AS INTEGER))) AS bar
      FROM plan JOIN durations USING (session_id))"""),
        "sequence_xml": _xml_sql("Rough Cut", True),
        "long_session_xml": _xml_sql("Rough Cut", True, _LONG),
        "sequence_xml_video": _xml_sql("A &lt;b&gt; &amp; c", False),
    }
