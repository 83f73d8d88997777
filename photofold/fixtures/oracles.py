"""SQL over the given tables that states what each registered query must return."""

from __future__ import annotations

from photofold.fixtures.views import GLOBAL_ACTIONS, VOCABULARY
from photofold.functions.vocabulary import (
    BIRD_WORDS,
    CAT_WORDS,
    DOG_WORDS,
    PEOPLE_DISQUALIFIERS,
    PEOPLE_WORDS,
    SCAN_DISQUALIFIERS,
    SCREENSHOT_WORDS,
    TRANSLATION_OVERRIDES,
)

NOW = 1_800_000_000_000


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return ", ".join(text(v) for v in values)


def word(column: str, words) -> str:
    return f"regexp_matches({column}, '\\b(?:{'|'.join(words)})\\b')"


def group_sql(label: str) -> str:
    low = f"lower({label})"
    return f"""CASE WHEN {word(low, CAT_WORDS)} THEN 'cat'
      WHEN {low} = 'cardigan' THEN 'dog'
      WHEN {word(low, DOG_WORDS)} THEN
        CASE WHEN {word(low, ['prairie'])} AND {word(low, ['dog'])} THEN NULL ELSE 'dog' END
      WHEN {word(low, BIRD_WORDS)} THEN 'bird'
      WHEN {word(low, SCREENSHOT_WORDS)} THEN 'screenshot'
      WHEN {word(low, PEOPLE_WORDS)} THEN 'people' END"""


MILLIS = "(epoch_us(ts) // 1000)"
SECONDS = "(epoch_us(ts) // 1000000)"
SIZE = "((event_id * 7919) % 5000000)"


def key(number: str = "event_id", prefix: str = "a") -> str:
    return f"('{prefix}' || lpad(CAST({number} AS VARCHAR), 9, '0'))"


LABELS = f"""CASE WHEN event_id % 6 > 0 THEN list_transform(range(0, event_id % 6), lambda i:
  {{'text': [{texts(VOCABULARY)}][((event_id * 7 + i * 5) % 24) + 1],
    'confidence': ((event_id * 31 + i * 17) % 100) / 100.0::DOUBLE}}) END"""

_slot_media = " ".join(f"WHEN event_id % 997 = {k} THEN '{m}'" for k, (m, _) in GLOBAL_ACTIONS.items())
_slot_action = " ".join(f"WHEN event_id % 997 = {k} THEN '{a}'" for k, (_, a) in GLOBAL_ACTIONS.items())
_slots = ", ".join(map(str, GLOBAL_ACTIONS))


def listing_rows(prefix: str, condition: str) -> str:
    return f"""SELECT {key(prefix=prefix)} AS asset_id,
    CASE WHEN event_id % 7 = 0 THEN 'video' ELSE 'photo' END AS media_type,
    {MILLIS} AS creation_time,
    CAST(640 + (event_id * 37) % 3400 AS INTEGER) AS width,
    CAST(480 + (event_id * 53) % 2600 AS INTEGER) AS height,
    'media://' || {key(prefix=prefix)} AS uri,
    CASE WHEN event_id % 10 <> 0 THEN 'file:///' || {key(prefix=prefix)} END AS local_uri,
    {SECONDS} AS mtime,
    {SIZE} + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS size
  FROM events WHERE {condition}"""


# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "hashes": (
        [],
        """SELECT vec_id, CAST(list_sum(list_transform(range(0, 64), lambda i:
             CASE WHEN embedding[i + 1] < 0 THEN CAST(pow(2, i) AS UBIGINT) ELSE 0::UBIGINT END))
             AS UBIGINT) AS bits FROM embeddings""",
    ),
    "assets": (
        ["hashes"],
        f"""SELECT {key()} AS asset_id,
    CASE WHEN event_id % 97 <> 0 THEN {MILLIS} END AS taken_at,
    CAST(CASE WHEN event_id % 53 <> 0 THEN 640 + (event_id * 37) % 3400 END AS INTEGER) AS width,
    CAST(480 + (event_id * 53) % 2600 AS INTEGER) AS height,
    {SECONDS} || '_' || {SIZE} AS file_signature,
    CAST(CASE WHEN event_id % 11 <> 0 THEN 1 + event_id % 4 END AS INTEGER) AS algo_version,
    value * 4 AS blur_score,
    CAST((event_id * 13) % 256 AS DOUBLE) AS mean_luma,
    CASE WHEN event_id % 101 <> 0 THEN lower(lpad(to_hex(
      xor(bits, CAST((event_id * 2654435761) & 1048575 AS UBIGINT))), 16, '0')) END AS phash,
    {LABELS} AS labels, event_id % 67 = 0 AS bad_json,
    CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 0 ELSE 1 END AS status,
    CASE WHEN event_type = 'error' THEN 'decode failed' END AS error_message,
    {MILLIS} AS updated_at,
    CAST(CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 1 + event_id % 3
      ELSE 0 END AS INTEGER) AS face_count, event_id
  FROM events JOIN hashes ON vec_id = (event_id // 4) % (SELECT count(*) FROM embeddings)""",
    ),
    "parsed": (["assets"], "SELECT *, CASE WHEN NOT bad_json THEN labels END AS ok FROM assets"),
    "detections": (
        [],
        f"""SELECT {key()} AS asset_id, event_id,
    CAST(CASE WHEN event_id % 53 <> 0 THEN 640 + (event_id * 37) % 3400 END AS INTEGER) AS width,
    {LABELS} AS raw,
    CASE WHEN event_id % 29 <> 0 THEN list_transform(range(0, event_id % 3 + 1), lambda i:
      CAST((event_id * 17 + i * 211) % 900 AS DOUBLE)) END AS face_widths FROM events""",
    ),
    "media_listing": (
        [],
        listing_rows("a", "event_id % 19 <> 0")
        + " UNION ALL "
        + listing_rows("n", "event_id % 23 = 0"),
    ),
    "album_assets": (
        [],
        f"""SELECT 'alb' || (user_id % 8) AS album_id, {key()} AS asset_id FROM events
    UNION ALL SELECT 'alb' || ((user_id + 3) % 8), {key()} FROM events WHERE event_id % 4 = 0""",
    ),
    "review_events": (
        [],
        f"""SELECT event_id AS seq,
    CASE WHEN event_id % 997 NOT IN ({_slots}) THEN {key('event_id % 200')} END AS asset_id,
    CASE {_slot_media} WHEN (event_id % 200) % 7 = 0 THEN 'video' ELSE 'photo' END AS media_type,
    CASE {_slot_action} WHEN (event_id % 200) % 7 = 0 THEN
      CASE WHEN event_type IN ('click', 'purchase') THEN 'trash'
           WHEN event_type IN ('error', 'signup') THEN 'restore' ELSE 'processed' END
      ELSE CASE event_type WHEN 'click' THEN 'delete' WHEN 'purchase' THEN 'collect'
           WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'album' ELSE 'skip' END END AS action
  FROM events""",
    ),
    "review_state": (
        ["review_events"],
        """SELECT * FROM (
  WITH g AS (SELECT media_type,
      max(seq) FILTER (action IN ('confirm','confirm_failed','batch_reset','load','progress_reset')) AS clear_delete,
      max(seq) FILTER (action IN ('batch_reset','load','progress_reset')) AS clear_collection,
      max(seq) FILTER (action IN ('confirm','progress_reset')) AS clear_trash,
      max(seq) FILTER (action = 'progress_reset') AS reset
    FROM review_events WHERE asset_id IS NULL GROUP BY media_type),
  epochs AS (SELECT *, count(*) FILTER (asset_id IS NULL AND action IN ('confirm','progress_reset'))
      OVER (PARTITION BY media_type ORDER BY seq) AS epoch FROM review_events),
  moves AS (SELECT *, lag(action) OVER w AS before, lag(epoch) OVER w AS epoch_before FROM epochs
    WHERE media_type = 'video' AND asset_id IS NOT NULL AND action IN ('trash','restore')
    WINDOW w AS (PARTITION BY asset_id ORDER BY seq)),
  works AS (SELECT asset_id, max(seq) AS restored FROM moves
    WHERE action = 'restore' AND before = 'trash' AND epoch = epoch_before GROUP BY asset_id),
  p AS (SELECT asset_id, max(seq) FILTER (action IN ('delete','collect','skip','album')) AS marked,
      max(seq) FILTER (action = 'undo') AS undo, max(seq) FILTER (action = 'delete') AS del,
      max(seq) FILTER (action = 'collect') AS col
    FROM review_events WHERE media_type = 'photo' AND asset_id IS NOT NULL GROUP BY asset_id),
  v AS (SELECT asset_id, max(seq) FILTER (action IN ('trash','processed')) AS marked,
      max(seq) FILTER (action = 'trash') AS trash, max(seq) FILTER (action = 'restore') AS tried
    FROM review_events WHERE media_type = 'video' AND asset_id IS NOT NULL GROUP BY asset_id)
  SELECT asset_id, 'photo' AS media_type,
    coalesce(marked, -2) > greatest(coalesce(undo, -1), coalesce(reset, -1)) AS processed,
    coalesce(del, -2) > greatest(coalesce(undo, -1), coalesce(clear_delete, -1)) AS in_delete_queue,
    coalesce(col, -2) > greatest(coalesce(undo, -1), coalesce(clear_collection, -1)) AS in_collection_queue,
    false AS in_trash,
    CASE WHEN coalesce(del, -2) > greatest(coalesce(undo, -1), coalesce(clear_delete, -1)) THEN del END AS queued_at
  FROM p LEFT JOIN g ON g.media_type = 'photo'
  UNION ALL
  SELECT v.asset_id, 'video', coalesce(marked, -2) > greatest(coalesce(restored, -1), coalesce(reset, -1)),
    false, false, coalesce(trash, -2) > greatest(coalesce(tried, -1), coalesce(clear_trash, -1)), NULL
  FROM v LEFT JOIN works USING (asset_id) LEFT JOIN g ON g.media_type = 'video')""",
    ),
    "face_groups": (
        [],
        f"""SELECT 'f' || user_id AS face_id,
    CAST(CASE WHEN user_id % 5 <> 0 THEN user_id % 7 END AS INTEGER) AS cluster_id,
    {key('min(event_id)')} AS first_seen_asset_id, CAST(NULL AS VARCHAR) AS representative_uri,
    CAST(count(*) AS INTEGER) AS photo_count,
    arg_min(epoch_us(ts) // 1000, event_id) AS created_at FROM events GROUP BY user_id""",
    ),
    "face_instances": (
        [],
        f"""SELECT 'i' || event_id AS instance_id, 'f' || user_id AS face_id, {key()} AS asset_id,
    {{'x': 0.0::DOUBLE, 'y': CAST(event_id % 10 AS DOUBLE), 'width': CAST((event_id * 17) % 900 AS DOUBLE),
      'height': CAST((event_id * 19) % 900 AS DOUBLE)}} AS bounding_box, 0.85::DOUBLE AS confidence,
    {MILLIS} AS seen_at FROM events WHERE event_id % 5 = 0""",
    ),
    "ml_attempts": (
        [],
        """SELECT 's' || user_id AS session_id, event_id AS seq,
    event_type IN ('error', 'signup') AS failed FROM events""",
    ),
    "dup_members": (
        [],
        f"""SELECT 'g' || user_id AS group_id, {key()} AS asset_id,
    CAST((event_id * 7) % 15 AS INTEGER) AS distance
  FROM events WHERE event_type NOT IN ('error', 'signup')""",
    ),
    "dup_groups": (
        [],
        f"""SELECT 'g' || user_id AS group_id,
    CASE WHEN user_id % 9 <> 0 THEN {key('min(event_id)')} END AS representative_asset_id,
    CASE WHEN user_id % 4 <> 0 THEN {key('max(event_id)')} END AS best_asset_id,
    1700000000000 + (user_id % 50) * 1000 AS created_at FROM events GROUP BY user_id""",
    ),
    "content": (
        [],
        """SELECT 'd' || doc_id AS asset_id, to_base64(encode(text)) AS b64 FROM documents
    UNION ALL SELECT 'p' || page_id, to_base64(encode(html)) FROM pages""",
    ),
    "features": (
        ["content"],
        """SELECT asset_id,
    CASE WHEN n = 0 THEN 150.0 ELSE greatest(0.0, least(500.0, (n - 5000) / 45000.0::DOUBLE * 500)) END AS blur_score,
    CASE WHEN n = 0 THEN 128.0 ELSE floor(((list_sum(list_transform(range(1, least(1000, n) + 1),
      lambda i: ascii(b64[i]))) / least(1000, n)) - 43) / 79.0::DOUBLE * 255 + 0.5) END AS mean_luma,
    CASE WHEN n = 0 THEN repeat('0', 16) ELSE lower(lpad(to_hex(CAST(list_sum(list_transform(range(0, 64), lambda i:
      CASE WHEN ascii(b64[CAST(i * (n // 65) + 1 AS INTEGER)]) < ascii(b64[CAST((i + 1) * (n // 65) + 1 AS INTEGER)])
      THEN CAST(pow(2, i) AS UBIGINT) ELSE 0::UBIGINT END)) AS UBIGINT)), 16, '0')) END AS phash
  FROM (SELECT asset_id, b64, length(b64) AS n FROM content)""",
    ),
    "pending_features": (
        ["assets", "features"],
        """SELECT a.asset_id, f.asset_id IS NULL AS bad, f.blur_score, f.mean_luma, f.phash
    FROM (SELECT * FROM assets WHERE status = 0) a LEFT JOIN
      (SELECT CAST(asset_id[2:] AS BIGINT) AS n, * FROM features WHERE asset_id[1] = 'd') f ON a.event_id = f.n""",
    ),
    "next_hash": (
        ["assets"],
        """SELECT asset_id, CAST('0x' || phash AS UBIGINT) AS mine,
      CAST('0x' || lead(phash) OVER (ORDER BY event_id) AS UBIGINT) AS other,
      lead(event_id) OVER (ORDER BY event_id) = event_id + 1 AS follows FROM assets""",
    ),
    "chain_targets": (
        [],
        """SELECT 'g' || user_id AS source_id, 'g' || (user_id - user_id % 4) AS target_id FROM events
    WHERE user_id % 4 <> 0 GROUP BY user_id""",
    ),
    "summary": (
        ["roots", "scored"],
        """SELECT root_id, count(*) AS n, first(asset_id ORDER BY score DESC, asset_id) AS best_asset_id
    FROM roots JOIN scored USING (asset_id) GROUP BY root_id HAVING count(*) > 1""",
    ),
    "scan_order": (
        ["assets"],
        """SELECT asset_id, taken_at, CAST('0x' || phash AS UBIGINT) AS bits,
    row_number() OVER (ORDER BY taken_at, asset_id) AS rn
  FROM assets WHERE status = 1 AND taken_at IS NOT NULL AND taken_at <> 0""",
    ),
    "edges": (
        ["scan_order"],
        """SELECT asset_id, parent_id, distance FROM (
    SELECT x.asset_id, y.asset_id AS parent_id, CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance,
      row_number() OVER (PARTITION BY x.asset_id ORDER BY bit_count(xor(x.bits, y.bits)), k) AS pick
    FROM scan_order x, range(1, 10) t(k), scan_order y
    WHERE y.rn = x.rn - k AND x.taken_at - y.taken_at <= 120000 AND bit_count(xor(x.bits, y.bits)) < 15)
  WHERE pick = 1""",
    ),
    "roots": (
        ["edges"],
        """SELECT asset_id, root_id, distance_to_parent FROM (
    WITH RECURSIVE tree AS (
      SELECT s.asset_id, s.asset_id AS root_id, CAST(NULL AS INTEGER) AS distance_to_parent
      FROM scan_order s LEFT JOIN edges e USING (asset_id) WHERE s.bits IS NOT NULL AND e.asset_id IS NULL
      UNION ALL
      SELECT e.asset_id, t.root_id, e.distance FROM tree t JOIN edges e ON e.parent_id = t.asset_id)
    SELECT * FROM tree)""",
    ),
    "library_order": (
        ["assets"],
        """SELECT 'L' || ((event_id // 40) % 5) AS library_id, asset_id, taken_at, CAST('0x' || phash AS UBIGINT) AS bits,
    row_number() OVER (PARTITION BY (event_id // 40) % 5 ORDER BY taken_at, asset_id) AS rn
  FROM assets WHERE status = 1 AND taken_at IS NOT NULL AND taken_at <> 0""",
    ),
    "library_edges": (
        ["library_order"],
        """SELECT asset_id, parent_id, distance FROM (
    SELECT x.asset_id, y.asset_id AS parent_id, CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance,
      row_number() OVER (PARTITION BY x.asset_id ORDER BY bit_count(xor(x.bits, y.bits)), k) AS pick
    FROM library_order x, range(1, 10) t(k), library_order y
    WHERE y.library_id = x.library_id AND y.rn = x.rn - k AND x.taken_at - y.taken_at <= 120000
      AND bit_count(xor(x.bits, y.bits)) < 15)
  WHERE pick = 1""",
    ),
    "library_roots": (
        ["library_edges"],
        """SELECT library_id, asset_id, root_id, distance_to_parent FROM (
    WITH RECURSIVE tree AS (
      SELECT s.library_id, s.asset_id, s.asset_id AS root_id, CAST(NULL AS INTEGER) AS distance_to_parent
      FROM library_order s LEFT JOIN library_edges e USING (asset_id) WHERE s.bits IS NOT NULL AND e.asset_id IS NULL
      UNION ALL
      SELECT t.library_id, e.asset_id, t.root_id, e.distance FROM tree t JOIN library_edges e ON e.parent_id = t.asset_id)
    SELECT * FROM tree)""",
    ),
    # Four slices of the time order; the newest time of the slices before, less the delay, is the watermark.
    "arriving": (
        ["assets"],
        """SELECT asset_id, event_id, taken_at - CASE WHEN event_id % 9 = 4 THEN 86400000 * (event_id % 3) ELSE 0 END AS taken_at,
      CASE WHEN n <= t // 4 THEN 0 WHEN n <= t * 2 // 4 THEN 1 WHEN n <= t * 3 // 4 THEN 2 ELSE 3 END AS slice
    FROM (SELECT a.*, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS t
          FROM assets a JOIN events USING (event_id))""",
    ),
    "arrived": (
        ["arriving"],
        """SELECT a.*, coalesce(w.newest - 21600000, 0) AS watermark FROM arriving a LEFT JOIN (
      SELECT s.slice, max(b.taken_at) AS newest FROM range(0, 4) s(slice) JOIN arriving b ON b.slice < s.slice GROUP BY s.slice) w
      USING (slice)""",
    ),
    "scored": (
        ["assets"],
        """SELECT asset_id,
    CASE WHEN coalesce(width, 0) * coalesce(height, 0) > 0
      THEN log10(CAST(width AS DOUBLE) * height) * 10 ELSE 0.0 END AS resolution,
    least(coalesce(blur_score, 0), 500) / 5 AS sharpness,
    greatest(0.0, 40 - abs(coalesce(mean_luma, 128) - 140)) AS lighting,
    CASE WHEN coalesce(width, 0) * coalesce(height, 0) > 0
      THEN log10(CAST(width AS DOUBLE) * height) * 10 ELSE 0.0 END
      + least(coalesce(blur_score, 0), 500) / 5
      + greatest(0.0, 40 - abs(coalesce(mean_luma, 128) - 140)) AS score FROM assets""",
    ),
    "translations": (
        [],
        "SELECT * FROM (VALUES "
        + ", ".join(f"({text(k)}, {text(v)})" for k, v in TRANSLATION_OVERRIDES.items())
        + ") t(label, zh)",
    ),
    "picked": (
        ["parsed"],
        f"""SELECT asset_id, taken_at, status, face_count, people_out, top_text,
      CASE WHEN top_text IS NULL THEN NULL WHEN hit IS NULL THEN top_group ELSE hit.grp END AS pick_group,
      CASE WHEN top_text IS NULL THEN NULL WHEN hit IS NULL THEN coalesce(top_group, top_text)
        ELSE hit.grp END AS pick_label
    FROM (SELECT *, cands[1].txt AS top_text, cands[1].grp AS top_group,
        list_filter(cands, lambda c: (coalesce(c.grp, '') IN ('cat', 'dog') AND cands[1].conf < 0.8)
          OR coalesce(c.grp, '') = 'people')[1] AS hit
      FROM (SELECT *, list_transform(list_filter(ok, lambda x: x.confidence > 0.4)[1:5], lambda x:
            {{'txt': x.text, 'conf': x.confidence, 'grp': {group_sql('x.text')}}}) AS cands,
          coalesce(len(list_filter(ok, lambda x: x.confidence > 0.4
            AND lower(x.text) IN ({texts(PEOPLE_DISQUALIFIERS)}))) > 0, false) AS people_out FROM parsed))""",
    ),
    "categorized_limited": (
        ["picked"],
        """SELECT asset_id, face AS from_face,
      CASE WHEN face OR pick_group = 'people' THEN 'people' WHEN pick_label IS NOT NULL THEN 'object' END AS kind,
      CASE WHEN face THEN CASE WHEN face_count > 1 THEN 'people_group' ELSE 'people_single' END
           WHEN pick_group = 'people' THEN 'people_single'
           WHEN pick_label IS NOT NULL THEN upper(pick_label[1]) || pick_label[2:] END AS category
    FROM (SELECT *, NOT people_out AND face_count > 0 AND coalesce(face_rank, 201) <= 200 AS face,
        status = 1 AND labeled_rank <= 5000 AS labeled FROM (
      SELECT *, row_number() OVER (PARTITION BY face_count > 0 ORDER BY taken_at DESC NULLS LAST, asset_id DESC) AS face_rank,
        row_number() OVER (PARTITION BY status = 1 ORDER BY taken_at DESC NULLS LAST, asset_id DESC) AS labeled_rank
      FROM picked)) WHERE coalesce(face, false) OR labeled""",
    ),
    "categorized": (
        ["picked"],
        """SELECT asset_id, taken_at, face AS from_face,
      CASE WHEN face OR pick_group = 'people' THEN 'people' WHEN pick_label IS NOT NULL THEN 'object' END AS kind,
      CASE WHEN face THEN CASE WHEN face_count > 1 THEN 'people_group' ELSE 'people_single' END
           WHEN pick_group = 'people' THEN 'people_single'
           WHEN pick_label IS NOT NULL THEN upper(pick_label[1]) || pick_label[2:] END AS category
    FROM (SELECT *, coalesce(face_count > 0, false) AND NOT people_out AS face FROM picked)
    WHERE face OR status = 1""",
    ),
}


def with_views(names: list[str] | str, select: str) -> str:
    """``select`` with the named views, and what they need, as common table expressions."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in wanted:
            wanted.append(name)

    for name in [names] if isinstance(names, str) else names:
        visit(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name][1]})" for name in wanted)
    return f"WITH {ctes}\n{select}"


NEWEST_NULLS_LAST = "taken_at DESC NULLS LAST, asset_id DESC"
CATALOG = (
    "asset_id, taken_at, width, height, file_signature, algo_version, blur_score, mean_luma, "
    "phash, status, error_message, updated_at, face_count"
)
LISTING_SIGNATURE = "mtime || '_' || size"


def rollup_sql(condition: str, source: str = "categorized") -> str:
    return f"""SELECT kind, category, count(*) AS count, arg_max(asset_id, rk) AS cover_asset_id
    FROM (SELECT *, row_number() OVER (PARTITION BY kind, category
        ORDER BY from_face, taken_at NULLS FIRST, asset_id) AS rk FROM {source}) WHERE {condition}
    GROUP BY kind, category"""


def title_sql(label: str) -> str:
    return f"upper({label}[1]) || {label}[2:]"


def zh_sql(source: str, label: str) -> str:
    """Chinese titles of ``label`` in ``source`` (a table with a distinct label column)."""
    return f"""SELECT {label}, coalesce(
      (SELECT zh FROM translations t WHERE t.label = trim(lower(s.{label}))),
      (SELECT arg_min(zh, pos) FROM (SELECT unnest(string_split(lower(s.{label}), ',')) AS part,
          unnest(range(0, len(string_split(lower(s.{label}), ',')))) AS pos) p
        JOIN translations t ON t.label = trim(p.part)),
      {title_sql('s.' + label)}) AS title FROM {source} s"""


ORACLES: dict[str, str] = {
    # 2.1 sources, catalog writes
    "scan_media": with_views(
        "media_listing",
        """SELECT asset_id, creation_time, width, height, row_number() OVER (ORDER BY creation_time, asset_id) AS rank
      FROM media_listing WHERE media_type = 'photo'""",
    ),
    "scan_media_albums": with_views(
        ["media_listing", "album_assets"],
        """SELECT asset_id, creation_time FROM media_listing WHERE media_type = 'photo' AND asset_id IN
        (SELECT asset_id FROM album_assets WHERE album_id IN ('alb1', 'alb4'))""",
    ),
    "file_signature": with_views(
        "media_listing", f"SELECT asset_id, {LISTING_SIGNATURE} AS file_signature FROM media_listing"
    ),
    "sync_catalog": with_views(
        ["assets", "media_listing"],
        f"""SELECT coalesce(a.asset_id, l.asset_id) AS asset_id,
      CASE WHEN a.asset_id IS NULL THEN l.creation_time ELSE a.taken_at END AS taken_at,
      CASE WHEN a.asset_id IS NULL THEN l.width ELSE a.width END AS width,
      CASE WHEN l.asset_id IS NOT NULL THEN {LISTING_SIGNATURE} ELSE a.file_signature END AS file_signature,
      CASE WHEN a.asset_id IS NULL OR a.file_signature <> {LISTING_SIGNATURE} THEN 0 ELSE a.status END AS status,
      CASE WHEN a.asset_id IS NULL OR a.file_signature <> {LISTING_SIGNATURE} THEN {NOW} ELSE a.updated_at END AS updated_at,
      CASE WHEN a.asset_id IS NULL THEN 'insert' WHEN a.file_signature <> {LISTING_SIGNATURE} THEN 'reset'
        ELSE 'keep' END AS action
    FROM assets a FULL JOIN (SELECT * FROM media_listing WHERE media_type = 'photo') l ON a.asset_id = l.asset_id""",
    ),
    "join_sync": with_views(
        ["assets", "media_listing"],
        f"""SELECT action, count(*) AS n FROM (
      SELECT CASE WHEN a.asset_id IS NULL THEN 'insert' WHEN a.file_signature <> {LISTING_SIGNATURE} THEN 'reset'
        ELSE 'keep' END AS action
      FROM assets a FULL JOIN (SELECT * FROM media_listing WHERE media_type = 'photo') l
        ON a.asset_id = l.asset_id) GROUP BY action""",
    ),
    "upsert_coalesce": with_views(
        ["assets"],
        f"""SELECT coalesce(a.asset_id, u.asset_id) AS asset_id,
      coalesce(u.width, a.width) AS width, coalesce(u.blur_score, a.blur_score) AS blur_score,
      CASE WHEN u.asset_id IS NULL THEN a.status ELSE u.status END AS status, a.phash AS phash,
      CASE WHEN u.asset_id IS NULL THEN a.updated_at ELSE {NOW} END AS updated_at
    FROM assets a FULL JOIN (
      SELECT {key('user_id * 3')} AS asset_id,
        arg_max(CAST(event_id % 500 AS INTEGER), event_id) FILTER (event_type = 'view') AS width,
        arg_max(value, event_id) FILTER (event_type = 'click') AS blur_score,
        arg_max(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END, event_id) AS status
      FROM events GROUP BY user_id) u ON a.asset_id = u.asset_id""",
    ),
    "insert_or_replace": with_views(
        ["dup_members"],
        f"""SELECT group_id, asset_id, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY group_id, asset_id ORDER BY seq DESC) AS rn FROM (
        SELECT group_id, asset_id, distance, -1 AS seq FROM dup_members
        UNION ALL SELECT 'g' || user_id, {key('event_id % 300')}, CAST(event_id % 15 AS INTEGER), event_id FROM events))
    WHERE rn = 1""",
    ),
    "meta_replace": with_views(
        ["assets"],
        """SELECT 'global_algo_version' AS key, '1' AS value
    UNION ALL SELECT 'scan_cursor_taken_at', CAST(max(taken_at) AS VARCHAR) FROM assets WHERE status <> 0
    UNION ALL SELECT 'scan_cursor_asset_id', (SELECT asset_id FROM assets WHERE status <> 0 AND taken_at IS NOT NULL
      ORDER BY taken_at DESC, asset_id DESC LIMIT 1)""",
    ),
    "mark_results": with_views(
        ["assets", "pending_features"],
        f"""SELECT a.asset_id, CASE WHEN f.asset_id IS NULL OR bad THEN a.blur_score ELSE round(f.blur_score, 6) END AS blur_score,
      CASE WHEN f.asset_id IS NULL OR bad THEN a.phash ELSE f.phash END AS phash,
      CASE WHEN f.asset_id IS NULL THEN a.status WHEN bad THEN 2 ELSE 1 END AS status,
      CASE WHEN f.asset_id IS NULL THEN a.error_message WHEN bad THEN 'Asset not found or no local URI' END AS error_message,
      CASE WHEN f.asset_id IS NULL OR bad THEN a.algo_version ELSE 5 END AS algo_version,
      CASE WHEN f.asset_id IS NULL THEN a.updated_at ELSE {NOW} END AS updated_at
    FROM assets a LEFT JOIN pending_features f USING (asset_id)""",
    ),
    "mark_done": with_views(
        "pending_features",
        """SELECT asset_id, round(blur_score, 6) AS blur_score, mean_luma, phash, 1 AS status
    FROM pending_features WHERE NOT bad""",
    ),
    "mark_error": with_views(
        "pending_features",
        """SELECT asset_id, 2 AS status, 'Asset not found or no local URI' AS error_message
    FROM pending_features WHERE bad""",
    ),
    "scan": with_views(
        ["assets", "media_listing", "features", "detections"],
        f"""SELECT c.asset_id,
      CASE WHEN NOT due THEN status WHEN f.asset_id IS NULL THEN 2 ELSE 1 END AS status,
      round(CASE WHEN due AND f.asset_id IS NOT NULL THEN f.blur_score ELSE c.blur_score END, 6) AS blur_score,
      CASE WHEN due AND f.asset_id IS NOT NULL THEN f.phash ELSE c.phash END AS phash,
      CASE WHEN due AND f.asset_id IS NOT NULL THEN 3 ELSE algo_version END AS algo_version,
      CASE WHEN due AND f.asset_id IS NOT NULL THEN CAST(CASE WHEN len(list_filter(d.raw, lambda x: x.confidence > 0.4
          AND lower(x.text) IN ({texts(SCAN_DISQUALIFIERS)}) AND x.shown)) > 0 THEN 0
        ELSE coalesce(len(list_filter(d.face_widths, lambda w: w > coalesce(nullif(c.width, 0), 1000) * 0.1::DOUBLE)), 0)
        END AS INTEGER) ELSE face_count END AS face_count,
      CASE WHEN NOT due THEN error_message WHEN f.asset_id IS NULL THEN 'Asset not found or no local URI' END AS error_message,
      CASE WHEN due AND f.asset_id IS NOT NULL THEN coalesce(len(d.raw) > 0, false) ELSE has_labels END AS has_labels
    FROM (SELECT coalesce(a.asset_id, l.asset_id) AS asset_id, blur_score, phash, algo_version, error_message, status,
        CASE WHEN a.asset_id IS NULL THEN l.width ELSE a.width END AS width,
        CASE WHEN a.asset_id IS NULL THEN 0 ELSE face_count END AS face_count,
        a.asset_id IS NULL OR status = 0 OR coalesce(a.file_signature <> {LISTING_SIGNATURE}, false)
          OR (status = 1 AND coalesce(algo_version, 0) < 3) AS due,
        coalesce(bad_json OR labels IS NOT NULL, false) AS has_labels
      FROM assets a FULL JOIN (SELECT * FROM media_listing WHERE media_type = 'photo') l ON a.asset_id = l.asset_id) c
    LEFT JOIN (SELECT {key('doc_id')} AS asset_id, blur_score, phash FROM features JOIN documents
      ON asset_id = 'd' || doc_id) f ON f.asset_id = c.asset_id
    LEFT JOIN (SELECT asset_id, face_widths, list_transform(range(0, len(raw)), lambda i: {{'text': raw[i + 1].text,
      'confidence': raw[i + 1].confidence, 'shown': (event_id + i) % 4 <> 0}}) AS raw FROM detections) d
      ON d.asset_id = c.asset_id""",
    ),
    "album_list": with_views(
        "album_assets",
        "SELECT album_id, count(*) AS asset_count FROM album_assets GROUP BY album_id "
        "UNION ALL SELECT 'alb_empty', 0",
    ),
    "album_move": with_views(
        ["album_assets", "review_events"],
        """SELECT album_id, asset_id FROM album_assets
      UNION SELECT 'favourites', asset_id FROM review_events WHERE action = 'collect' AND asset_id IS NOT NULL""",
    ),
    "album_move_listing": with_views(
        ["media_listing", "review_events"],
        """SELECT asset_id, media_type FROM media_listing WHERE asset_id NOT IN
      (SELECT asset_id FROM review_events WHERE action = 'collect' AND asset_id IS NOT NULL)""",
    ),
    "load_label_vocab": """SELECT doc_id, CAST(pos AS INTEGER) AS idx, line AS label FROM (
      SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (
        SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') AS ls FROM documents))""",
    "load_translations": f"""SELECT label, arg_max(zh, p) AS zh FROM (
      SELECT label, max(zh) AS zh, 0 AS p FROM (
        SELECT lower(p_name) AS label, p_brand AS zh FROM part) WHERE label <> '' GROUP BY label
      UNION ALL SELECT label, zh, 1 FROM (VALUES {", ".join(f"({text(k)}, {text(v)})" for k, v in TRANSLATION_OVERRIDES.items())}) t(label, zh))
    GROUP BY label""",
    # 2.2 projections and filters
    "lookup_by_key": with_views(
        ["face_instances"],
        "SELECT instance_id, face_id, asset_id, confidence FROM face_instances WHERE face_id IN ('f1', 'f7', 'f30')",
    ),
    "lookup_by_table": with_views(
        ["assets", "face_instances"],
        "SELECT asset_id, taken_at, status FROM assets WHERE asset_id IN (SELECT asset_id FROM face_instances)",
    ),
    "group_of_asset": with_views(
        "dup_members", "SELECT asset_id, min(group_id) AS group_id FROM dup_members GROUP BY asset_id"
    ),
    "pending_filter": with_views("assets", "SELECT asset_id, taken_at FROM assets WHERE status = 0"),
    "blurry_static": with_views(
        "assets", "SELECT asset_id, blur_score, mean_luma FROM assets WHERE status = 1 AND blur_score < 100"
    ),
    "blurry_static_top": with_views(
        "assets",
        """SELECT asset_id, blur_score, mean_luma, CAST(row_number() OVER (ORDER BY blur_score, asset_id) AS INTEGER) AS rank
      FROM assets WHERE status = 1 AND blur_score < 100 ORDER BY rank LIMIT 50""",
    ),
    "blurry_adaptive": with_views(
        "assets",
        """SELECT asset_id, blur_score, mean_luma, threshold AS adjusted_threshold, blur_score < threshold AS is_blurry
    FROM (SELECT *, CASE WHEN mean_luma < 40 OR mean_luma > 220 THEN 100 * 0.7::DOUBLE ELSE 100.0::DOUBLE END AS threshold
      FROM assets)""",
    ),
    "blur_score_only": with_views(
        "features", "SELECT asset_id, round(blur_score, 6) AS blur_score, mean_luma FROM features"
    ),
    "valid_labels": with_views(
        "parsed",
        """SELECT asset_id, array_to_string(list_transform(list_filter(ok, lambda x: x.confidence > 0.4),
      lambda x: x.text), '|') AS texts FROM parsed""",
    ),
    "top_labels": with_views(
        "parsed",
        """SELECT asset_id, string_agg(t, '|' ORDER BY c DESC, i) AS texts FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY c DESC, i) AS r FROM (
        SELECT asset_id, unnest(ok).text AS t, unnest(ok).confidence AS c, unnest(range(0, len(ok))) AS i FROM parsed)
      WHERE c >= 0.4) WHERE r <= 5 GROUP BY asset_id""",
    ),
    "faces_min_size": with_views(
        "detections",
        """SELECT asset_id, CAST(len(list_filter(face_widths, lambda w:
      w > coalesce(nullif(width, 0), 1000) * 0.1::DOUBLE)) AS INTEGER) AS large_faces FROM detections""",
    ),
    "context_disqualified": with_views(
        "parsed",
        f"""SELECT asset_id, coalesce(len(list_filter(ok, lambda x: x.confidence > 0.4
      AND lower(x.text) IN ({texts(SCAN_DISQUALIFIERS)}))) > 0, false) AS disqualified FROM parsed""",
    ),
    "people_disqualified": with_views(
        "parsed",
        f"""SELECT asset_id, coalesce(len(list_filter(ok, lambda x: x.confidence > 0.4
      AND lower(x.text) IN ({texts(PEOPLE_DISQUALIFIERS)}))) > 0, false) AS disqualified FROM parsed""",
    ),
    "valid_face_count": with_views(
        "detections",
        f"""SELECT asset_id, CAST(CASE WHEN len(list_filter(raw, lambda x: x.confidence > 0.4
        AND lower(x.text) IN ({texts(SCAN_DISQUALIFIERS)}))) > 0 THEN 0
      ELSE coalesce(len(list_filter(face_widths, lambda w: w > coalesce(nullif(width, 0), 1000) * 0.1::DOUBLE)), 0)
      END AS INTEGER) AS face_count FROM detections""",
    ),
    "is_screenshot": with_views(
        "parsed",
        """SELECT asset_id, coalesce(len(list_filter(ok, lambda x:
      regexp_matches(lower(x.text), 'text|font|website|screenshot'))) > 0, false) AS screenshot FROM parsed""",
    ),
    "people_assets": with_views(
        "assets", "SELECT asset_id, taken_at, face_count FROM assets WHERE face_count > 0"
    ),
    "people_assets_top": with_views(
        "assets",
        f"""SELECT asset_id, taken_at, face_count, CAST(row_number() OVER (ORDER BY {NEWEST_NULLS_LAST}) AS INTEGER) AS rank
      FROM assets WHERE face_count > 0 ORDER BY rank LIMIT 200""",
    ),
    "labeled_assets": with_views("assets", "SELECT asset_id, taken_at FROM assets WHERE status = 1"),
    "labeled_assets_top": with_views(
        "assets",
        f"SELECT asset_id, taken_at FROM assets WHERE status = 1 ORDER BY {NEWEST_NULLS_LAST} LIMIT 5000",
    ),
    "reset_outdated": with_views(
        "assets",
        f"""SELECT asset_id, CASE WHEN old THEN 0 ELSE status END AS status,
      CASE WHEN old THEN {NOW} ELSE updated_at END AS updated_at
    FROM (SELECT *, status = 1 AND (algo_version IS NULL OR algo_version < 3) AS old FROM assets)""",
    ),
    "count_outdated": with_views(
        "assets",
        "SELECT count(*) AS reset_count FROM assets WHERE status = 1 AND (algo_version IS NULL OR algo_version < 3)",
    ),
    "reset_all": with_views(
        "assets",
        f"""SELECT asset_id, 0 AS status, blur_score, phash, algo_version, CAST(NULL AS INTEGER) AS face_count,
      CAST(NULL AS VARCHAR) AS labels_json, CAST(NULL AS VARCHAR) AS error_message, {NOW} AS updated_at FROM assets""",
    ),
    "reset_all_rows": """SELECT 'catalog' AS "table", count(*) AS "rows" FROM events UNION ALL SELECT 'groups', 0
      UNION ALL SELECT 'members', 0 UNION ALL SELECT 'meta', 1""",
    "center_crop_rect": with_views(
        "assets",
        """SELECT asset_id, (width - size) / 2.0::DOUBLE AS origin_x, (height - size) / 2.0::DOUBLE AS origin_y, size
    FROM (SELECT *, CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN least(width, height) END AS size FROM assets)""",
    ),
    "hash_similar": with_views(
        "next_hash", "SELECT asset_id, bit_count(xor(mine, other)) < 15 AS similar FROM next_hash WHERE follows"
    ),
    # 2.3 joins
    "find_similar": with_views(
        ["assets"],
        """SELECT target_id, asset_id, distance, CAST(recency AS INTEGER) AS recency FROM (
      SELECT x.asset_id AS target_id, y.asset_id, y.phash IS NOT NULL AS usable,
        CAST(bit_count(xor(CAST('0x' || x.phash AS UBIGINT), CAST('0x' || y.phash AS UBIGINT))) AS INTEGER) AS distance,
        row_number() OVER (PARTITION BY x.asset_id ORDER BY y.taken_at DESC, y.asset_id DESC) AS recency
      FROM (SELECT * FROM assets WHERE phash IS NOT NULL AND taken_at IS NOT NULL) x JOIN
        (SELECT * FROM assets WHERE status = 1 AND taken_at IS NOT NULL) y
        ON y.taken_at BETWEEN x.taken_at - 120000 AND x.taken_at + 120000)
    WHERE recency <= 10 AND usable AND distance < 15""",
    ),
    "group_members": with_views(
        "dup_members",
        """SELECT group_id, asset_id, distance, CAST(row_number() OVER
      (PARTITION BY group_id ORDER BY distance, asset_id) AS INTEGER) AS member_rank FROM dup_members""",
    ),
    "group_assets": with_views(
        ["dup_groups", "dup_members", "assets"],
        """SELECT g.group_id, a.asset_id, a.taken_at, a.phash FROM dup_groups g
      JOIN dup_members USING (group_id) JOIN assets a USING (asset_id)""",
    ),
    "live_semi": with_views(
        ["assets", "media_listing"],
        """SELECT r.asset_id, blur_score, coalesce(nullif(local_uri, ''), nullif(uri, '')) AS uri FROM (
      SELECT * FROM assets WHERE status = 1 AND blur_score < 100) r
      JOIN media_listing USING (asset_id)""",
    ),
    "anti_processed": with_views(
        ["media_listing", "review_state"],
        """SELECT asset_id, media_type FROM media_listing WHERE asset_id NOT IN
      (SELECT asset_id FROM review_state WHERE processed)""",
    ),
    "anti_categorized": with_views(
        ["assets", "categorized"],
        """SELECT asset_id FROM assets ANTI JOIN (SELECT asset_id FROM categorized WHERE kind IS NOT NULL) USING (asset_id)
      WHERE status = 1""",
    ),
    "album_restrict": with_views(
        ["media_listing", "album_assets"],
        """SELECT asset_id, album_id, creation_time FROM media_listing JOIN album_assets USING (asset_id)
      WHERE album_id IN ('alb1', 'alb4', 'alb6')""",
    ),
    "label_index_join": with_views(
        "detections",
        f"""SELECT asset_id, array_to_string(list_transform(range(0, len(raw)), lambda i:
      CASE WHEN (event_id + i) % 4 <> 0 THEN raw[i + 1].text ELSE
        coalesce([{texts(VOCABULARY)}][CAST((event_id * 3 + i) % 30 + 1 AS INTEGER)], 'Unknown') END), '|') AS texts
      FROM detections""",
    ),
    "translate_join": with_views(
        ["parsed", "translations", "picked"],
        f"""SELECT asset_id, pick_label AS label, title FROM picked JOIN
      ({zh_sql('(SELECT DISTINCT pick_label FROM picked WHERE pick_label IS NOT NULL)', 'pick_label')}) USING (pick_label)""",
    ),
    "representative_uri": with_views(
        ["dup_groups", "dup_members", "media_listing"],
        """SELECT group_id, coalesce(nullif(l.local_uri, ''), nullif(l.uri, '')) AS representative_uri, coalesce(n, 0) AS member_count
    FROM dup_groups g LEFT JOIN (SELECT group_id, count(*) AS n, arg_min(asset_id, distance || '') AS x,
        first(asset_id ORDER BY distance, asset_id) AS first_id FROM dup_members GROUP BY group_id) m USING (group_id)
      LEFT JOIN media_listing l ON l.asset_id = coalesce(g.representative_asset_id, m.first_id)""",
    ),
    # 2.4 duplicate grouping
    "dup_edges": with_views("edges", "SELECT asset_id, parent_id, distance FROM edges"),
    "dup_groups": with_views(
        "roots",
        """SELECT 'grp_' || root_id AS group_id, asset_id, root_id AS representative_asset_id, 0 AS distance,
      distance_to_parent FROM roots""",
    ),
    "merge_groups": with_views(
        ["dup_members", "chain_targets"],
        """SELECT coalesce(target_id, group_id) AS group_id, asset_id, min(distance) AS distance
      FROM dup_members LEFT JOIN chain_targets ON group_id = source_id GROUP BY 1, 2""",
    ),
    "merge_groups_left": with_views(
        "dup_groups", "SELECT group_id, created_at FROM dup_groups WHERE CAST(group_id[2:] AS INTEGER) % 4 = 0"
    ),
    "delete_group": with_views(
        ["dup_members", "dup_groups"],
        """SELECT group_id, asset_id, distance FROM dup_members WHERE group_id NOT IN
      (SELECT group_id FROM dup_groups WHERE representative_asset_id IS NULL)""",
    ),
    "list_groups": with_views(
        "dup_groups",
        """SELECT group_id, representative_asset_id, best_asset_id, created_at,
      row_number() OVER (ORDER BY created_at DESC, group_id) AS rank FROM dup_groups""",
    ),
    # 2.5 aggregations
    "status_counts": with_views(
        "assets",
        """SELECT count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 1) AS done,
      count(*) FILTER (status = 2) AS error FROM assets""",
    ),
    "face_statistics": with_views(
        "face_groups",
        """SELECT count(DISTINCT face_id) AS total_faces, count(DISTINCT cluster_id) AS total_clusters
      FROM face_groups WHERE cluster_id IS NOT NULL""",
    ),
    "face_group_counts": with_views(
        "face_instances",
        """SELECT face_id, count(*) AS photo_count, arg_min(asset_id, seen_at) AS first_seen_asset_id,
      min(seen_at) AS created_at FROM face_instances GROUP BY face_id""",
    ),
    "face_cluster_assign": with_views(
        "face_groups",
        """SELECT face_id, CASE WHEN photo_count > 60 THEN CAST(photo_count % 4 AS INTEGER) ELSE cluster_id END AS cluster_id
      FROM face_groups""",
    ),
    "list_face_groups": with_views(
        "face_groups", "SELECT face_id, photo_count, created_at FROM face_groups"
    ),
    "score_assets": with_views(
        "scored",
        """SELECT asset_id, round(resolution, 6) AS resolution, round(sharpness, 6) AS sharpness,
      round(lighting, 6) AS lighting, round(score, 6) AS score FROM scored""",
    ),
    "best_shot": with_views(
        ["roots", "scored"],
        """SELECT 'grp_' || root_id AS group_id, asset_id AS best_asset_id, round(score, 6) AS score FROM (
      SELECT root_id, asset_id, score, row_number() OVER (PARTITION BY root_id ORDER BY score DESC, asset_id) AS r
      FROM roots JOIN scored USING (asset_id)) WHERE r = 1""",
    ),
    "best_shot_changes": with_views(
        ["dup_members", "dup_groups", "scored"],
        """SELECT count(*) AS changed_groups FROM dup_groups g JOIN (
      SELECT group_id, asset_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, asset_id) AS r
      FROM dup_members JOIN scored USING (asset_id)) b ON g.group_id = b.group_id AND r = 1
      WHERE b.asset_id IS DISTINCT FROM g.best_asset_id""",
    ),
    "group_summary": with_views(
        ["summary", "media_listing"],
        """SELECT 'grp_' || root_id AS group_id, n AS member_count, best_asset_id, uri AS representative_uri,
        row_number() OVER (ORDER BY 'grp_' || root_id) AS rank FROM summary LEFT JOIN
        (SELECT asset_id, coalesce(nullif(local_uri, ''), nullif(uri, '')) AS uri FROM media_listing) l
        ON l.asset_id = root_id""",
    ),
    "group_summary_members": with_views(
        ["summary", "roots"],
        """SELECT 'grp_' || root_id AS group_id, asset_id,
      CAST(row_number() OVER (PARTITION BY root_id ORDER BY asset_id) AS INTEGER) AS member_rank
      FROM roots SEMI JOIN summary USING (root_id)""",
    ),
    "category_rollup": with_views("categorized", rollup_sql("kind IS NOT NULL")),
    "people_rollup": with_views(
        "picked",
        f"""SELECT category, count(*) AS count, first(asset_id ORDER BY {NEWEST_NULLS_LAST}) AS cover_asset_id FROM (
      SELECT *, CASE WHEN face_count > 1 THEN 'people_group' ELSE 'people_single' END AS category
      FROM picked WHERE face_count > 0 AND NOT people_out) GROUP BY category""",
    ),
    "uncategorized_summary": with_views(
        ["categorized", "assets"],
        f"""SELECT 'Uncategorized' || CASE WHEN p > 0 THEN ' (+' || p || ' processing)' ELSE '' END AS title,
      n + p AS count, cover_asset_id FROM (SELECT
        (SELECT count(*) FROM assets WHERE status = 0) AS p, (SELECT count(*) FROM categorized WHERE kind IS NULL) AS n,
        (SELECT first(asset_id ORDER BY {NEWEST_NULLS_LAST}) FROM categorized WHERE kind IS NULL) AS cover_asset_id)
      WHERE n + p > 0""",
    ),
    "total_counts": with_views(
        "media_listing", "SELECT media_type, count(*) AS total FROM media_listing GROUP BY media_type"
    ),
    "review_progress": with_views(
        ["media_listing", "review_state"],
        """SELECT media_type, coalesce(n, 0) AS processed, total FROM
      (SELECT media_type, count(*) AS total FROM media_listing GROUP BY media_type) LEFT JOIN
      (SELECT media_type, count(*) FILTER (processed) AS n FROM review_state GROUP BY media_type) USING (media_type)""",
    ),
    "remaining_after_delete": with_views(
        ["dup_members", "review_events"],
        """SELECT group_id, count(*) FILTER (asset_id NOT IN (SELECT asset_id FROM review_events
          WHERE action IN ('delete', 'trash') AND asset_id IS NOT NULL)) AS remaining,
        count(*) FILTER (asset_id NOT IN (SELECT asset_id FROM review_events
          WHERE action IN ('delete', 'trash') AND asset_id IS NOT NULL)) <= 1 AS processed
      FROM dup_members GROUP BY group_id""",
    ),
    "vocab_duplicates": """SELECT line AS label, count(*) AS occurrences FROM (
      SELECT unnest(regexp_split_to_array(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n')) AS line FROM documents)
      GROUP BY line HAVING count(*) > 1""",
    # 2.6 windows
    "topk_candidates": with_views(
        ["assets"],
        """SELECT target_id, count(*) AS n, min(recency) AS newest_match FROM (
      SELECT x.asset_id AS target_id, y.phash IS NOT NULL AS usable,
        bit_count(xor(CAST('0x' || x.phash AS UBIGINT), CAST('0x' || y.phash AS UBIGINT))) AS distance,
        CAST(row_number() OVER (PARTITION BY x.asset_id ORDER BY y.taken_at DESC, y.asset_id DESC) AS INTEGER) AS recency
      FROM (SELECT * FROM assets WHERE phash IS NOT NULL AND taken_at IS NOT NULL) x JOIN
        (SELECT * FROM assets WHERE status = 1 AND taken_at IS NOT NULL) y
        ON y.taken_at BETWEEN x.taken_at - 120000 AND x.taken_at + 120000)
    WHERE recency <= 10 AND usable AND distance <= 64 GROUP BY target_id""",
    ),
    "prev9_frame": with_views(
        "scan_order",
        """SELECT x.asset_id, count(*) AS compared FROM scan_order x, range(1, 10) t(k), scan_order y
      WHERE y.rn = x.rn - k AND x.taken_at - y.taken_at <= 120000 GROUP BY x.asset_id""",
    ),
    "best_rank": with_views(
        ["dup_members", "scored"],
        """SELECT group_id, asset_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, asset_id) AS INTEGER)
      AS best_rank FROM dup_members JOIN scored USING (asset_id)""",
    ),
    "scan_batches": with_views(
        "assets",
        """SELECT asset_id, (row_number() OVER (ORDER BY taken_at NULLS FIRST, asset_id) - 1) // 20 AS batch
      FROM assets WHERE status = 0""",
    ),
    "per_album_top_n": with_views(
        ["media_listing", "album_assets"],
        """SELECT * FROM (SELECT album_id, asset_id, CAST(row_number() OVER (PARTITION BY album_id
        ORDER BY creation_time DESC, asset_id DESC) AS INTEGER) AS album_rank
      FROM media_listing JOIN album_assets USING (asset_id)) WHERE album_rank <= 500""",
    ),
    "failure_streak": with_views(
        "ml_attempts",
        """SELECT session_id, seq, failed, coalesce(seq > min(CASE WHEN streak = 4 THEN seq END)
        OVER (PARTITION BY session_id), false) AS disabled FROM (
      SELECT *, sum(CAST(failed AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq
        ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS streak FROM ml_attempts)""",
    ),
    "dedupe_keep_first": """SELECT page_id, CAST(pos AS INTEGER) AS idx, line AS label,
      row_number() OVER (PARTITION BY page_id, line ORDER BY pos) > 1 AS is_duplicate FROM (
        SELECT page_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (
          SELECT page_id, regexp_split_to_array(regexp_replace(replace(html, '><', '>\n<'), '\\r?\\n$', ''), '\\r?\\n') AS ls
          FROM pages))""",
    # 2.7 sorts, limits
    "keyset_page": with_views(
        "assets",
        """SELECT asset_id, taken_at, CAST(row_number() OVER (ORDER BY taken_at, asset_id) AS INTEGER) AS rank FROM assets WHERE status = 0 AND (taken_at > 1705000000000
      OR (taken_at = 1705000000000 AND asset_id > 'a')) ORDER BY taken_at, asset_id LIMIT 20""",
    ),
    "keyset_first_page": with_views(
        "assets",
        "SELECT asset_id, taken_at, CAST(row_number() OVER (ORDER BY taken_at NULLS FIRST, asset_id) AS INTEGER) AS rank FROM assets WHERE status = 0 ORDER BY taken_at NULLS FIRST, asset_id LIMIT 20",
    ),
    "review_batch": with_views(
        ["media_listing", "album_assets", "review_state"],
        """SELECT asset_id, album_id, creation_time,
      CAST(row_number() OVER (ORDER BY album_id, creation_time DESC, asset_id DESC) AS INTEGER) AS rank
      FROM media_listing JOIN album_assets USING (asset_id) WHERE media_type = 'photo' AND album_id IN ('alb2', 'alb5')
        AND asset_id NOT IN (SELECT asset_id FROM review_state WHERE processed) ORDER BY rank LIMIT 30""",
    ),
    "review_batch_capped": with_views(
        ["media_listing", "album_assets", "review_state"],
        """SELECT asset_id, album_id, creation_time,
      CAST(row_number() OVER (ORDER BY album_id, creation_time DESC, asset_id DESC) AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY creation_time DESC, asset_id DESC) AS r
      FROM media_listing JOIN album_assets USING (asset_id)
      WHERE media_type = 'photo' AND album_id IN ('alb2', 'alb5')) WHERE r <= 500 AND asset_id NOT IN
        (SELECT asset_id FROM review_state WHERE processed) ORDER BY rank LIMIT 30""",
    ),
    "review_batch_reviewed": with_views(
        "media_listing",
        """SELECT asset_id, creation_time, CAST(row_number() OVER (ORDER BY creation_time DESC, asset_id DESC) AS INTEGER) AS rank
      FROM (SELECT * FROM media_listing WHERE media_type = 'photo' ORDER BY creation_time DESC, asset_id DESC OFFSET 600)
      ORDER BY rank LIMIT 30""",
    ),
    "review_batch_oldest": with_views(
        ["media_listing", "review_state"],
        """SELECT asset_id, creation_time, CAST(row_number() OVER (ORDER BY creation_time, asset_id) AS INTEGER) AS rank
      FROM media_listing WHERE media_type = 'video' AND asset_id NOT IN
        (SELECT asset_id FROM review_state WHERE processed) ORDER BY rank LIMIT 20""",
    ),
    "review_batch_random": with_views(
        ["media_listing", "review_state"],
        """SELECT asset_id, creation_time, CAST(row_number() OVER (ORDER BY md5('7|' || asset_id), asset_id) AS INTEGER) AS rank
      FROM media_listing WHERE media_type = 'photo' AND asset_id NOT IN
        (SELECT asset_id FROM review_state WHERE processed) ORDER BY rank LIMIT 30""",
    ),
    "shuffle": with_views(
        "media_listing",
        "SELECT asset_id, row_number() OVER (ORDER BY md5('7|' || asset_id), asset_id) AS rank FROM media_listing",
    ),
    "processed_last": with_views(
        "dup_groups",
        """SELECT group_id, created_at, best_asset_id IS NULL AS processed,
      row_number() OVER (ORDER BY best_asset_id IS NULL, created_at DESC, group_id) AS rank FROM dup_groups""",
    ),
    "thumb_topn": with_views(
        "review_state",
        """SELECT media_type, array_to_string(list(asset_id ORDER BY queued_at, asset_id)[1:9], '|') AS shown, count(*) AS queued,
      greatest(count(*) - 9, 0) AS overflow FROM review_state WHERE in_delete_queue GROUP BY media_type""",
    ),
    "group_thumbs": with_views(
        "dup_members",
        """SELECT group_id, array_to_string(list(asset_id ORDER BY distance, asset_id)[1:4], '|') AS shown,
      greatest(count(*) - 4, 0) AS overflow FROM dup_members GROUP BY group_id""",
    ),
    # 2.8 set operations
    "union_albums": with_views(
        ["media_listing", "album_assets"],
        """SELECT asset_id, creation_time FROM media_listing JOIN album_assets USING (asset_id)
      WHERE album_id IN ('alb0', 'alb3')""",
    ),
    "union_albums_distinct": with_views(
        ["media_listing", "album_assets"],
        """SELECT DISTINCT asset_id, creation_time FROM media_listing JOIN album_assets USING (asset_id)
      WHERE album_id IN ('alb0', 'alb3')""",
    ),
    "people_merge": with_views(
        "categorized",
        f"SELECT category, count, cover_asset_id FROM ({rollup_sql(chr(107) + 'ind = ' + chr(39) + 'people' + chr(39))})",
    ),
    "uncategorized": with_views(
        "categorized", "SELECT asset_id, taken_at FROM categorized WHERE kind IS NULL"
    ),
    "pending_bucket": with_views(
        ["categorized", "assets"],
        f"""SELECT 'obj_' || category AS id, category AS title, count, cover_asset_id, 0 AS section FROM ({rollup_sql("kind = 'object'")})
    UNION ALL SELECT 'status_pending', 'Processing (' || n || ')', n, NULL, 1 FROM
      (SELECT count(*) AS n FROM assets WHERE status = 0) WHERE n > 0""",
    ),
    # 2.9 functions
    "hamming64": with_views(
        "next_hash",
        "SELECT asset_id, CAST(bit_count(xor(mine, other)) AS INTEGER) AS distance FROM next_hash WHERE follows",
    ),
    "mean_luma": with_views("features", "SELECT asset_id, mean_luma FROM features"),
    "laplacian_var": with_views("features", "SELECT asset_id, round(blur_score, 6) AS blur_score FROM features"),
    "dhash64": with_views("features", "SELECT asset_id, phash FROM features"),
    "image_features": with_views(
        "features", "SELECT asset_id, round(blur_score, 6) AS blur_score, mean_luma, phash FROM features"
    ),
    "category_group": with_views(
        "assets",
        f"SELECT label, {group_sql('label')} AS category_group, count(*) AS n FROM "
        "(SELECT unnest(labels).text AS label FROM assets) GROUP BY label",
    ),
    "pick_label": with_views(
        "picked", "SELECT asset_id, pick_group, pick_label FROM picked"
    ),
    "translate_label": with_views(
        ["assets", "translations"],
        f"""SELECT label, title, n FROM (SELECT label, count(*) AS n FROM (
        SELECT unnest(labels).text AS label FROM assets) GROUP BY label) JOIN
      ({zh_sql('(SELECT DISTINCT label FROM (SELECT unnest(labels).text AS label FROM assets))', 'label')}) USING (label)""",
    ),
    "localize": """SELECT doc_id, replace_first AS shown FROM (SELECT doc_id,
      CASE WHEN lang = 'en' THEN source || ': ' || n_chars || ' of {n}' WHEN lang = 'de' THEN source || ' (' || n_chars || ')'
        ELSE 'settings_progress' END AS replace_first FROM documents)""",
    "parse_labels": with_views(
        "parsed",
        """SELECT asset_id, i, t AS text, c AS confidence FROM (SELECT asset_id, unnest(ok).text AS t, unnest(ok).confidence AS c,
      CAST(unnest(range(0, len(ok))) AS INTEGER) AS i FROM parsed)""",
    ),
    "serialize_labels": with_views(
        "assets",
        """SELECT asset_id, '[' || array_to_string(list_transform(labels, lambda x:
      '{"text":"' || x.text || '","confidence":' || CAST(x.confidence AS VARCHAR) || '}'), ',') || ']' AS labels_json FROM assets""",
    ),
    "bbox_json": with_views(
        "face_instances",
        """SELECT instance_id, '{"x":' || CAST(bounding_box.x AS VARCHAR) || ',"y":' || CAST(bounding_box.y AS VARCHAR) ||
      ',"width":' || CAST(bounding_box.width AS VARCHAR) || ',"height":' || CAST(bounding_box.height AS VARCHAR) || '}' AS bounding_box
      FROM face_instances""",
    ),
    "detection_to_face": with_views(
        "face_instances",
        """SELECT instance_id, bounding_box.x AS x, bounding_box.y AS y, bounding_box.width AS width,
      bounding_box.height AS height, 0.85::DOUBLE AS confidence FROM face_instances""",
    ),
    "date_string": with_views(
        "media_listing",
        """SELECT asset_id, strftime(make_timestamp(creation_time * 1000), '%Y-%m-%d %H:%M') AS shown
      FROM media_listing""",
    ),
    "group_id": with_views("roots", "SELECT DISTINCT 'grp_' || root_id AS group_id FROM roots"),
    "categorize": with_views(
        "categorized", "SELECT asset_id, kind, category, from_face FROM categorized"
    ),
    "categorize_limited": with_views(
        "categorized_limited",
        "SELECT asset_id, kind, category, coalesce(from_face, false) AS from_face FROM categorized_limited",
    ),
    # 2.10 streaming
    "stream_ingest": with_views(
        "features",
        """SELECT asset_id, round(blur_score, 6) AS blur_score, mean_luma, phash, 1 AS status FROM features
      WHERE asset_id LIKE 'd%'""",
    ),
    "stream_dup_groups": with_views(
        "roots", "SELECT 'grp_' || root_id AS group_id, asset_id, distance_to_parent FROM roots"
    ),
    "scan_media_pages": with_views(
        "media_listing", "SELECT asset_id, creation_time, width, height FROM media_listing WHERE media_type = 'photo'"
    ),
    "scan_plugged": with_views(
        "assets",
        """SELECT asset_id, CASE WHEN a.status <> 0 THEN a.status WHEN doc_id IS NULL THEN 2 ELSE 1 END AS status,
      CASE WHEN a.status = 0 AND doc_id IS NOT NULL THEN CAST(octet_length(encode(text)) AS DOUBLE) ELSE blur_score END AS blur_score,
      CASE WHEN a.status = 0 AND doc_id IS NOT NULL THEN '00000000000000ff' ELSE phash END AS phash,
      CASE WHEN a.status = 0 AND doc_id IS NOT NULL THEN CASE WHEN octet_length(encode(text)) % 2 = 1 THEN 'odd' ELSE 'even' END
        WHEN NOT bad_json THEN labels[1].text END AS label
    FROM assets a LEFT JOIN documents ON doc_id = event_id
    WHERE CASE WHEN a.status = 0 AND doc_id IS NOT NULL THEN 3 ELSE algo_version END = 3""",
    ),
    "pending_images": with_views(
        "pending_features",
        """SELECT asset_id, round(blur_score, 6) AS blur_score, phash,
      CASE WHEN bad THEN 'Asset not found or no local URI' END AS error_message FROM pending_features""",
    ),
    "sink": with_views(
        "assets",
        """SELECT 'L' || ((event_id // 40) % 5) AS library_id, asset_id, blur_score, mean_luma FROM assets
    WHERE status = 1 AND blur_score < 100""",
    ),
    "keyset_page_clustered": with_views(
        "assets",
        """SELECT asset_id, taken_at FROM assets WHERE status = 0 AND (taken_at > 1705000000000
      OR (taken_at = 1705000000000 AND asset_id > 'a'))""",
    ),
    "face_statistics_sketched": with_views(
        "face_groups",
        """SELECT count(DISTINCT face_id) AS total_faces, count(DISTINCT cluster_id) AS total_clusters,
      true AS total_faces_close, true AS total_clusters_close FROM face_groups WHERE cluster_id IS NOT NULL""",
    ),
    "stream_regroup": with_views(
        "roots",
        "SELECT 'grp_' || root_id AS group_id, asset_id, root_id AS representative_asset_id, distance_to_parent FROM roots",
    ),
    "stream_keyed_groups": with_views(
        "library_roots", "SELECT library_id, asset_id, root_id AS representative_asset_id, distance_to_parent FROM library_roots"
    ),
    "stream_keyed_best": with_views(
        ["library_roots", "scored"],
        """SELECT library_id, 'grp_' || library_id || '_' || root_id AS group_id, asset_id AS best_asset_id, round(score, 6) AS score FROM (
      SELECT library_id, root_id, asset_id, score, row_number() OVER (PARTITION BY root_id ORDER BY score DESC, asset_id) AS r
      FROM library_roots JOIN scored USING (asset_id)) WHERE r = 1""",
    ),
    "stream_arrivals": with_views(
        "arrived",
        """SELECT asset_id, taken_at, CASE WHEN taken_at IS NULL THEN 'undated' WHEN taken_at < watermark THEN 'late' ELSE 'on_time' END
      AS arrival FROM arrived
    UNION ALL SELECT asset_id, taken_at, CASE WHEN taken_at IS NULL THEN 'undated' WHEN taken_at < watermark THEN 'late'
      ELSE 'repeat' END FROM arrived WHERE event_id % 10 = 0""",
    ),
    "stream_status": with_views("assets", "SELECT status, count(*) AS count FROM assets GROUP BY status"),
    "review_fold": with_views("review_state", "SELECT * FROM review_state"),
    "late_assets": with_views(
        "assets",
        """SELECT asset_id, taken_at FROM assets WHERE status = 0 AND NOT coalesce(taken_at > 1705000000000
      OR (taken_at = 1705000000000 AND asset_id > 'a'), false)""",
    ),
    "stream_on_time": with_views("assets", "SELECT asset_id, taken_at FROM assets WHERE taken_at IS NOT NULL"),
    "error_isolation": with_views(
        "assets",
        """SELECT asset_id, CASE WHEN doc_id IS NULL THEN 'Asset not found or no local URI' END AS error_message
    FROM assets LEFT JOIN documents ON doc_id = event_id""",
    ),
}
ORACLES["stream_best_shot"] = ORACLES["best_shot"]
ORACLES["stream_upsert"] = ORACLES["compact_buckets"] = ORACLES["upsert_coalesce"]
ORACLES["stream_media_pages"] = ORACLES["scan_media_pages"]
ORACLES["stream_review"] = ORACLES["stream_review_batches"] = ORACLES["review_fold"]
ORACLES["stream_status_batches"] = ORACLES["stream_status"]
