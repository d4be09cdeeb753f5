"""Registration of queries with their oracle SQL, and the SQL of the catalogue's views for it."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

STATUSES = ("queued", "running", "review", "ready", "scheduled", "posted", "error", "skipped")


def pick(expr: str, values: tuple[str, ...]) -> str:
    """SQL for the value at position ``expr`` modulo their number."""
    return f"CASE {expr} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: The same mappings as in lumora.sources.catalog, in DuckDB's dialect.
VIEWS = {
    "cues_src": "SELECT conv_id AS video_id, turn AS i, turn * 3.0e0 AS start_s, turn * 3.0e0 + least(3.0e0, greatest(0.3e0, length(text) / 400.0e0)) AS end_s, text AS txt FROM conversations",
    "cues_dst": "SELECT conv_id AS video_id, turn AS i, turn * 2.5e0 + 0.5e0 AS start_s, turn * 2.5e0 + 2.5e0 AS end_s, text AS txt, length(text) / 200.0e0 AS voice_s FROM conversations",
    "phash": "SELECT vec_id AS id, array_to_string(list_transform(range(0, 16), lambda n: lower(hex(CAST(8 * b[4 * n + 1] + 4 * b[4 * n + 2] + 2 * b[4 * n + 3] + b[4 * n + 4] AS TINYINT)))[-1:]), '') AS phash FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > list_sort(embedding[2:64])[32] THEN 1 ELSE 0 END) AS b FROM embeddings WHERE len(embedding) = 64)",
    "video_hashes": "SELECT film * 4 + j AS id, substr(h, 1, 64 - 6 * j) || repeat('0', 6 * j) AS phash FROM (SELECT id // 4 AS film, string_agg(phash, '' ORDER BY id) AS h FROM phash GROUP BY 1 HAVING count(*) = 4), (VALUES (0), (1), (2), (3)) AS copies(j)",
    "frame_hashes": "SELECT id * 2 + j AS id, substr(phash, 1, 16 - j) || repeat('0', j) AS phash FROM phash, (VALUES (0), (1)) AS twins(j)",
    "videos": f"SELECT doc_id AS id, source AS author, text AS title, n_chars / 10.0e0 AS duration_sec, md5(text) AS md5, p.phash AS phash, {pick('doc_id', STATUSES)} AS status, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, doc_id % 17 = 0 AS deleted FROM documents LEFT JOIN video_hashes p ON p.id = doc_id",
    "cost_logs": "SELECT event_id AS id, user_id AS video_id, CASE event_type WHEN 'click' THEN 'llm_translate' WHEN 'signup' THEN 'llm_translate' WHEN 'view' THEN 'tts' WHEN 'purchase' THEN 'gpu_inpaint' ELSE 'bandwidth' END AS service, CASE event_type WHEN 'click' THEN 'token' WHEN 'signup' THEN 'token' WHEN 'view' THEN 'second' WHEN 'purchase' THEN 'second' ELSE 'byte' END AS unit, floor(value * 100) AS quantity, value / 1000 AS cost_usd, ts AS created_at FROM events",
    "job_runs": "SELECT event_id AS id, user_id AS video_id, ts AS started_at, CAST(event_id % 12 AS INTEGER) AS step, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'running' ELSE 'success' END AS status, value AS duration_sec FROM events",
    "boxes": "SELECT event_id AS id, user_id AS video_id, 0.5e0 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS time, (event_id * 37 % 60) / 100.0e0 AS x, (event_id * 53 % 70) / 100.0e0 AS y, 0.2e0 AS w, 0.05e0 AS h, (event_id % 100) / 100.0e0 AS confidence, props AS txt FROM events",
    "stream_events": "SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'media:status:' ELSE 'media:progress:' END || user_id AS channel, '{\"video_id\":\"' || user_id || '\",\"status\":\"' || CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'ready' ELSE 'running' END || '\"}' AS payload, ts AS ingest_ts FROM events",
    "channels": f"SELECT s_suppkey AS id, {pick('s_nationkey', ('douyin', 'bilibili', 'kuaishou', 'xiaohongshu', 'weibo'))} AS platform, s_name AS display_name, s_suppkey % 3 <> 0 AS enabled, {pick('s_suppkey', ('unknown', 'permitted', 'licensed', 'open', 'own'))} AS license_status, TIMESTAMP '2024-01-01' + to_minutes(s_suppkey) AS created_at FROM supplier",
    "presets": f"SELECT p_partkey AS id, {pick('p_partkey', ('filter', 'process', 'antidup', 'subtitle'))} AS kind, p_name || ' ' || p_partkey AS name, p_partkey % 50 = 0 AS is_default FROM part",
    "voices": f"SELECT c_custkey AS id, c_name AS name, {pick('c_custkey', ('ready', 'pending', 'error'))} AS state, c_custkey = 7 AS is_default, TIMESTAMP '2024-01-01' + to_minutes(c_custkey * 7 % 1000) AS created_at FROM customer",
    "variants": f"SELECT l_orderkey AS video_id, {pick('l_orderkey', ('tiktok', 'youtube', 'facebook', 'instagram', 'zalo'))} AS platform, l_linenumber AS part, l_quantity AS duration_sec, l_extendedprice AS size_kb FROM lineitem",
    "masks": "SELECT id, video_id, x, y, w, h, time AS start_s, time + 1.0e0 AS end_s, confidence, CASE WHEN id % 4 = 0 THEN 'manual' ELSE 'auto' END AS source FROM boxes",
    "limits": "SELECT * FROM (VALUES ('tiktok', 0, 150, 2200, 30, 3, 0.06e0, 0.18e0, 0.05e0, 0.20e0), ('youtube', 0, 100, 5000, 15, 5, 0.06e0, 0.14e0, 0.05e0, 0.12e0), ('facebook', 0, 255, 2200, 30, 3, 0.08e0, 0.20e0, 0.05e0, 0.18e0), ('instagram', 0, 125, 2200, 30, 3, 0.08e0, 0.22e0, 0.05e0, 0.20e0), ('zalo', 0, 120, 1500, 20, 3, 0.06e0, 0.16e0, 0.05e0, 0.15e0)) AS t(platform, max_sec, title_len, desc_len, hashtags, daily, sa_top, sa_bottom, sa_left, sa_right)",
    "as_of": "SELECT max(ts) AS now FROM events",
}
NEEDS = {"videos": ("video_hashes",), "video_hashes": ("phash",), "frame_hashes": ("phash",), "masks": ("boxes",)}


def with_views(sql: str, first: str = "") -> str:
    """``sql`` with the views it names in front, as common table expressions; ``first`` holds its own."""
    names: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in names:
            names.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql + first):
            add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + ([first] if first else [])
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql


def query(name: str, sql: str | None = None, first: str = "") -> Callable:
    """Registers a query (spark, sf_dir) -> DataFrame, and its oracle if SQL can express it."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, first)
        return f

    return register
