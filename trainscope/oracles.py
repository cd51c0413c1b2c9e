"""The catalog's queries in SQL for DuckDB, over the same derived views.

Each is written from the meaning of the operator, not from its Spark form:
stacks are read line by line with running counts, snapshots are paired by
position, files are pruned per file.
"""

from __future__ import annotations

VIEWS = {
    "labelled": """
        SELECT *, 'node' || (rank_no // 4) AS node, 'RANK' || rank_no AS rank FROM (
          SELECT *, CAST(CASE WHEN user_id % 16 = 13 THEN 12 ELSE user_id % 16 END AS INTEGER) AS rank_no FROM events)""",
    "log_lines": """
        SELECT node, rank_no, rank, event_id AS line_no, event_type,
          event_id % 101 = 100 AS bad_time, event_id % 17 = 16 AND event_id % 101 <> 100 AS free,
          date_trunc('second', CASE WHEN rank_no IN (5, 6, 10, 15) THEN ts - INTERVAL 3 DAY ELSE ts END) AS log_ts,
          CASE event_type WHEN 'view' THEN 'LOG_INFO' WHEN 'click' THEN 'LOG_DEBUG' WHEN 'signup' THEN 'LOG_WARNING'
            WHEN 'error' THEN 'LOG_ERROR' ELSE 'INFO' END AS level_text, event_id // 500 AS epoch_no, props
        FROM labelled""",
    "log_text": """
        SELECT *, CASE WHEN free THEN 'free text ' || line_no ELSE
          '[Train][RANK ' || rank_no || '][' ||
          CASE WHEN bad_time THEN '2024-13-01 00:00:00' ELSE strftime(log_ts, '%Y-%m-%d %H:%M:%S') END ||
          '][' || level_text || '] [Train] (Epoch ' || epoch_no || ') step ' || props END AS line
        FROM log_lines""",
    "entries": """
        SELECT node, rank_no, rank, line_no, line AS message, CASE WHEN NOT free THEN log_ts END AS ts,
          CASE WHEN free THEN 0 ELSE CASE level_text WHEN 'LOG_INFO' THEN 2 WHEN 'LOG_DEBUG' THEN 1
            WHEN 'LOG_WARNING' THEN 3 WHEN 'LOG_ERROR' THEN 4 ELSE 0 END END AS level,
          CASE WHEN free THEN 0 ELSE CAST(epoch_no AS INTEGER) END AS epoch
        FROM log_text WHERE NOT bad_time""",
    "tails": """
        SELECT * FROM log_text QUALIFY row_number() OVER (PARTITION BY rank_no ORDER BY line_no DESC) <= 30""",
    "silence": """
        SELECT node, rank_no, rank, n_entries, latest,
          CASE WHEN n_entries = 0 THEN 0 ELSE CAST(date_diff('second', latest, TIMESTAMP '2024-01-31') AS INTEGER) END AS suspend_seconds
        FROM (SELECT node, rank_no, rank, count(*) FILTER (NOT bad_time) AS n_entries,
                coalesce(max(log_ts) FILTER (NOT bad_time AND NOT free), TIMESTAMP '2024-01-30') AS latest
              FROM tails GROUP BY ALL)""",
    "ranges": """
        SELECT DISTINCT node, (rank_no // 4) * 4 AS min_rank, (rank_no // 4) * 4 + 3 AS max_rank FROM labelled""",
    "expected": """
        SELECT node, 'RANK' || rank_no AS rank, rank_no, rank_no = max_rank AS is_top FROM (
          SELECT node, max_rank, unnest(range(min_rank, max_rank + 1)) AS rank_no FROM ranges)""",
    "completed": """
        SELECT e.node, e.rank, e.rank_no, e.is_top, CASE WHEN s.rank IS NULL THEN 1 ELSE s.n_entries END AS n_entries,
          CASE WHEN s.rank IS NULL THEN -10 ELSE s.suspend_seconds END AS suspend_seconds,
          CASE WHEN s.rank IS NULL THEN 'Log reading failed: no such file' ELSE '' END AS marker
        FROM expected e LEFT JOIN silence s ON e.rank = s.rank""",
    "event_store": """
        SELECT 'e' || event_id AS id, event_id, CASE WHEN event_id % 2 = 0 THEN 'training' ELSE 'system' END AS source,
          CASE event_id % 3 WHEN 0 THEN 'alert' WHEN 1 THEN 'audit' ELSE 'metric' END AS type,
          'job' || (user_id % 10) AS job_id, props AS message, epoch_us(ts) // 1000 AS "timestamp",
          CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS severity,
          event_id % 4 = 0 AS processed, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000 + 1000 ELSE 0 END AS processed_at,
          node, 'rank' || rank_no || '_events_' || strftime(ts, '%Y%m%d') AS path
        FROM labelled""",
    "ledger": """
        SELECT 'e' || (l_orderkey * 3) AS id, l_linestatus = 'F' AS processed,
          date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) * 86400000 AS processed_at,
          date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) * 10 + l_linenumber AS seq
        FROM lineitem""",
    "marks": """
        SELECT * FROM ledger
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, processed_at DESC, processed DESC) = 1""",
    "marked": """
        SELECT e.* EXCLUDE (processed, processed_at), coalesce(m.processed, e.processed) AS processed,
          coalesce(m.processed_at, e.processed_at) AS processed_at
        FROM event_store e LEFT JOIN marks m ON e.id = m.id""",
    "polled": """
        SELECT * FROM marked WHERE "timestamp" BETWEEN 1705276800000 AND 1706659200000 AND severity >= 1
          AND type = 'alert' AND NOT processed""",
    "asked": """
        SELECT DISTINCT node, CASE WHEN node = 'node3' THEN 'Failed to connect to node node3' END AS error FROM labelled
        UNION ALL SELECT 'node9', NULL""",
    "rollup": """
        SELECT a.node, a.error, CASE WHEN a.error IS NULL THEN count(p.id) ELSE 0 END AS n
        FROM asked a LEFT JOIN polled p ON a.node = p.node GROUP BY a.node, a.error""",
    "samples": """
        SELECT o_orderkey, o_custkey, snapshot_no, 'node' || (o_orderkey % 8) AS node,
          o_orderkey + CASE WHEN o_orderkey % 8 = 6 AND o_orderkey % 100 = 6 AND snapshot_no = 3 THEN 1000000000 ELSE 0 END AS pid,
          CASE WHEN o_orderkey % 8 = 4 AND snapshot_no = 1 THEN 'rank' ELSE 'RANK' END ||
            ((o_orderkey // 512) % 64 + CASE WHEN o_orderkey % 8 = 5 AND o_orderkey % 100 = 5 AND snapshot_no = 2 THEN 1 ELSE 0 END) AS rank,
          CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS type,
          CASE WHEN o_orderkey % 5 = 0 THEN 'PROCESS_DATA_LOADER' ELSE 'PROCESS_TRAINER' END AS kind,
          CAST(1 + o_custkey % 3 - CASE WHEN snapshot_no = 3 AND o_orderkey % 29 = 0 AND o_custkey % 3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_threads,
          '2024-01-31 00:00:' || lpad(CAST(snapshot_no * 5 AS VARCHAR), 2, '0') AS clock
        FROM orders, (SELECT unnest(range(0, 5)) AS snapshot_no)
        WHERE NOT (o_orderkey % 8 = 7 AND o_orderkey % 100 = 7 AND snapshot_no = 4)""",
    "check_samples": """
        SELECT o_orderkey, o_custkey, o_orderkey % 24 AS k, c, s, 'gpu' || (o_orderkey % 24) AS node,
          '2024-01-31 ' || CASE WHEN c = 0 THEN '10:00:00' WHEN o_orderkey % 24 % 4 = 2 THEN '10:00:40' ELSE '11:00:00' END AS check_id,
          '2024-01-31 ' || CASE WHEN c = 0 OR o_orderkey % 24 % 4 = 2 THEN '10' ELSE '11' END || ':00:' ||
            lpad(CAST(s * 5 + CASE WHEN c = 1 AND o_orderkey % 24 % 4 = 2 THEN 40 ELSE 0 END AS VARCHAR), 2, '0') AS snapshot_time,
          c = 1 AND s = 1 AND o_orderkey % 24 % 5 = 3 AS bare, c = 1 AND s = 2 AND o_orderkey % 24 % 6 = 1 AS broken,
          CASE WHEN o_orderkey % 24 % 3 = 0 AND o_orderkey % 11 = 0 THEN s ELSE 0 END AS step
        FROM orders, (SELECT unnest(range(0, 2)) AS c), (SELECT unnest(range(0, 3)) AS s)""",
    "check_facts": """
        SELECT node, k, check_id, CAST(s AS INTEGER) AS snapshot_no, snapshot_time, CAST(count(*) FILTER (NOT bare) AS INTEGER) AS n_processes
        FROM check_samples WHERE NOT broken GROUP BY ALL""",
    "thread_rows": """
        SELECT node, snapshot_no, pid, o_orderkey, o_custkey, t, n_threads,
          t + CASE WHEN snapshot_no = 1 AND o_orderkey % 37 = 0 AND t = n_threads THEN 100 ELSE 0 END AS thread_id,
          4 - CASE WHEN snapshot_no = 2 AND t = 1 AND o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS n_frames
        FROM (SELECT *, unnest(range(1, n_threads + 1)) AS t FROM samples)""",
    "frame_rows": """
        SELECT node, snapshot_no, pid, thread_id, n_frames, k,
          CASE WHEN snapshot_no = 4 AND o_orderkey % 41 = 0 THEN 'FILE' ELSE 'File' END || ' "mod' || ((o_custkey + k) % 97) ||
            '.py", line ' || (k * 10 + CASE WHEN k = 3 AND o_orderkey % 11 = 0 THEN snapshot_no ELSE 0 END) || ', in f' AS frame
        FROM (SELECT *, unnest(range(1, n_frames + 1)) AS k FROM thread_rows)""",
    "placed": """
        SELECT *, row_number() OVER (PARTITION BY node, snapshot_no ORDER BY pid) AS pos,
          count(*) OVER (PARTITION BY node, snapshot_no) AS n
        FROM samples""",
    "positions": """
        SELECT a.node, a.snapshot_no, a.pos, a.pid AS pid_a, b.pid AS pid_b, a.rank AS rank_a, b.rank AS rank_b, a.n AS n_a, b.n AS n_b,
          a.n_threads AS threads_a, b.n_threads AS threads_b, a.type, a.kind, a.clock AS t1, b.clock AS t2,
          CASE WHEN a.n <> b.n THEN 'process count mismatch: psa: ' || a.n || ', psb: ' || b.n
            WHEN lower(a.rank) <> lower(b.rank) THEN 'process ranks are different: ' || a.rank || ' and ' || b.rank
            WHEN a.pid <> b.pid THEN 'internal error, comparing two different processes. pid: ' || a.pid || ' and ' || b.pid END AS error
        FROM placed a JOIN placed b ON a.node = b.node AND a.snapshot_no = b.snapshot_no + 1 AND a.pos = b.pos""",
    "pair_errors": """
        SELECT node, snapshot_no, min_by(error, pos) AS error FROM positions WHERE error IS NOT NULL GROUP BY node, snapshot_no""",
    "pairs": """
        SELECT * EXCLUDE (error), pid_a AS pid FROM positions p
        WHERE NOT EXISTS (FROM pair_errors e WHERE e.node = p.node AND e.snapshot_no = p.snapshot_no)""",
    "thread_places": """
        SELECT *, row_number() OVER (PARTITION BY node, snapshot_no, pid ORDER BY thread_id) AS place FROM thread_rows""",
    "thread_diffs": """
        SELECT p.node, p.snapshot_no, p.pid, x.place, 0 AS level, x.thread_id <> y.thread_id AS other_id,
          x.thread_id AS id_a, y.thread_id AS id_b, x.n_frames AS frames_a, y.n_frames AS frames_b, '' AS frame_a, '' AS frame_b
        FROM pairs p JOIN thread_places x ON x.node = p.node AND x.snapshot_no = p.snapshot_no AND x.pid = p.pid
        JOIN thread_places y ON y.node = p.node AND y.snapshot_no = p.snapshot_no - 1 AND y.pid = p.pid AND y.place = x.place
        WHERE p.threads_a = p.threads_b""",
    "first_diffs": """
        SELECT * FROM (
          SELECT * FROM thread_diffs WHERE other_id OR frames_a <> frames_b
          UNION ALL
          SELECT d.node, d.snapshot_no, d.pid, d.place, f.k, false, d.id_a, d.id_b, d.frames_a, d.frames_b, f.frame, g.frame
          FROM thread_diffs d
          JOIN frame_rows f ON f.node = d.node AND f.snapshot_no = d.snapshot_no AND f.pid = d.pid AND f.thread_id = d.id_a
          JOIN frame_rows g ON g.node = d.node AND g.snapshot_no = d.snapshot_no - 1 AND g.pid = d.pid AND g.thread_id = d.id_b AND g.k = f.k
          WHERE d.id_a = d.id_b AND d.frames_a = d.frames_b AND lower(f.frame) <> lower(g.frame))
        QUALIFY row_number() OVER (PARTITION BY node, snapshot_no, pid ORDER BY place, level) = 1""",
    "diffs": """
        SELECT p.node, p.snapshot_no, p.pid, p.rank_a AS rank, p.type,
          CASE WHEN p.threads_a <> p.threads_b THEN
              'Detected different number of threads in process stack. ' || p.rank_a || ', Process type: ' || kind || ', Process ID:' || p.pid || chr(10) ||
              '[' || t1 || ']Thread count: ' || threads_a || chr(10) || '[' || t2 || ']Thread count: ' || threads_b || chr(10)
            WHEN d.other_id THEN
              'Detected different thread IDs. ' || p.rank_a || ', Process type: ' || kind || ', Process ID:' || p.pid || chr(10) ||
              '[' || t1 || ']Thread ID: ' || id_a || chr(10) || '[' || t2 || ']Thread ID: ' || id_b || chr(10)
            WHEN d.level = 0 THEN
              'Detected different number of thread stack frames. ' || p.rank_a || ', Process type: ' || kind || ', Process ID:' || p.pid || ', Thread ID: ' || id_a || chr(10) ||
              '[' || t1 || ']Frame count: ' || frames_a || chr(10) || '[' || t2 || ']Frame count: ' || frames_b || chr(10)
            ELSE
              'Detected different process stacks. ' || p.rank_a || ', Process type: ' || kind || ', Process ID:' || p.pid || ', Thread ID: ' || id_a || ', Stack frame level: ' || d.level || chr(10) ||
              '[' || t1 || ']Stack frame content: ' || frame_a || chr(10) || '[' || t2 || ']Stack frame content: ' || frame_b || chr(10) END AS diff
        FROM pairs p LEFT JOIN first_diffs d ON d.node = p.node AND d.snapshot_no = p.snapshot_no AND d.pid = p.pid
        WHERE p.threads_a <> p.threads_b OR d.pid IS NOT NULL""",
    "verdicts": """
        SELECT n.node, n.snapshot_no, CASE WHEN d.n IS NULL AND e.error IS NULL THEN 'noDiff' ELSE 'haveDiff' END AS verdict,
          coalesce(d.n, 0) AS diffs, coalesce(e.error, '') AS error
        FROM (SELECT DISTINCT node, CAST(unnest(range(1, 5)) AS INTEGER) AS snapshot_no FROM samples) n
        LEFT JOIN (SELECT node, snapshot_no, count(*) AS n FROM diffs GROUP BY ALL) d ON d.node = n.node AND d.snapshot_no = n.snapshot_no
        LEFT JOIN pair_errors e ON e.node = n.node AND e.snapshot_no = n.snapshot_no""",
    "dump_lines": """
        SELECT node, pid, generate_subscripts(lines, 1) AS line_no, unnest(lines) AS line FROM (
          SELECT node, pid, string_split(dump, chr(10)) AS lines FROM dumps)""",
    "dumps": """
        SELECT 'node' || (o_orderkey % 8) AS node, o_orderkey AS pid,
          'The frame stack for thread 1 is empty' || chr(10) || '    (Python) File "early.py", line 1, in f' || chr(10) ||
          (SELECT string_agg(
              'Traceback for thread ' || CASE WHEN o_orderkey % 13 = 0 AND t = 2 THEN 'x' ELSE CAST(t AS VARCHAR) END ||
              ' (' || o_orderpriority || ') [] (most recent call last):' || chr(10) ||
              CASE WHEN o_orderkey % 7 = 0 THEN '    orphan code' || chr(10) ELSE '' END ||
              (SELECT string_agg('    (Python) File "mod' || ((o_custkey + k) % 97) || '.py", line ' || (k * 10) || ', in f' || chr(10) ||
                 CASE WHEN k % 2 = 0 THEN '        call(a, b)' || chr(10) || chr(10)
                 ELSE '        x = 1' || chr(10) || '        y = 2' || chr(10) END, '' ORDER BY k) FROM range(1, 5) r(k)),
              chr(10) ORDER BY t) FROM (SELECT unnest(range(1, CAST(2 + o_custkey % 3 AS BIGINT))) AS t)) AS dump
        FROM orders""",
    "classed": """
        SELECT *, CASE WHEN starts_with(line, 'Traceback for thread') THEN 'thread' WHEN contains(line, '(Python) File') THEN 'frame'
          WHEN starts_with(line, '    ') AND NOT contains(line, 'File') AND trim(line) <> '' THEN 'code' END AS class
        FROM dump_lines""",
    "grouped_lines": """
        SELECT *, sum(CASE WHEN class = 'frame' THEN 1 ELSE 0 END) OVER (PARTITION BY pid, thread_no ORDER BY line_no) AS frame_no
        FROM (SELECT *, sum(CASE WHEN class = 'thread' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY line_no) AS thread_no FROM classed)
        WHERE thread_no > 0""",
    "frame_texts": """
        SELECT node, pid, thread_no, frame_no, string_agg(CASE WHEN class = 'frame' THEN trim(replace(line, '(Python) ', '')) ELSE trim(line) END, chr(10) ORDER BY line_no) AS frame
        FROM grouped_lines WHERE frame_no > 0 AND class IN ('frame', 'code') GROUP BY ALL""",
    "procs": """
        SELECT 'node' || (o_orderkey % 8) AS node, o_orderkey AS pid, o_orderkey % 5 = 0 AS worker,
          CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 8 ELSE -1000 - o_orderkey % 8 END AS ppid,
          o_orderkey % 37 <> 0 AS has_rank, CAST(o_orderkey AS INTEGER) AS rank, CAST(o_orderkey % 8 AS INTEGER) AS local_rank
        FROM orders""",
    "tree": """
        SELECT node, 'trainer' AS type, pid, ppid, rank, local_rank FROM procs WHERE NOT worker AND has_rank
        UNION ALL
        SELECT w.node, 'dataloader', w.pid, w.ppid, t.rank, t.local_rank FROM procs w
        JOIN procs t ON t.node = w.node AND t.pid = w.ppid AND NOT t.worker AND t.has_rank WHERE w.worker""",
    "rpc": """
        SELECT l_returnflag AS method, CASE WHEN l_linestatus = 'F' THEN 'error' ELSE 'success' END AS status,
          l_extendedprice / 10000 AS duration, l_shipdate AS ts, 'host' || (l_suppkey % 4) AS instance FROM lineitem""",
    "agents": """
        SELECT 'version' AS op, s_name AS node, '1.' || (s_nationkey % 3) AS version,
          CASE WHEN s_suppkey % 7 = 0 THEN 'connection refused' END AS error FROM supplier""",
    "answers": """
        SELECT op, node, version, error FROM agents UNION ALL SELECT 'alerts', node, NULL, error FROM asked""",
}

EVENT = 'id, source, type, job_id, message, "timestamp", severity, processed, processed_at'
IN_WINDOW = """"timestamp" BETWEEN 1704412800000 AND 1705708800000 AND severity >= 1 AND type = 'alert'
    AND source = 'system' AND NOT processed"""
RFC = "'%Y-%m-%dT%H:%M:%SZ'"
BUCKETS = "('0.005'), ('0.01'), ('0.025'), ('0.05'), ('0.1'), ('0.25'), ('0.5'), ('1'), ('2.5'), ('5'), ('10'), ('+Inf')"
MESSAGE_HEAD = """'【Alert Notification:】' || chr(10) || 'Node: ' || r.node || chr(10) || 'Processing time: 2024-01-31 00:00:00' || chr(10) ||
    '--------------------' || chr(10)"""

BODIES = {
    "log_tail": "SELECT node, rank, line_no, line FROM tails",
    "log_parse": f"SELECT node, rank, line_no, coalesce(strftime(ts, {RFC}), '') AS ts, level, epoch, message FROM entries",
    "log_epoch": "SELECT node, rank, max(epoch) AS epoch, count(*) AS entries FROM entries GROUP BY ALL",
    "latest_log_time": f"SELECT node, rank, n_entries AS entries, strftime(latest, {RFC}) AS latest FROM silence",
    "suspend_seconds": "SELECT node, rank, suspend_seconds FROM silence",
    "suspicious_ranks": "SELECT node, rank, suspend_seconds FROM silence WHERE suspend_seconds > 150000",
    "suspicious_nodes": """
        SELECT node, min_by(rank, rank_no) AS rank, min_by(suspend_seconds, rank_no) AS suspend_seconds
        FROM completed WHERE NOT is_top AND suspend_seconds > 150000 GROUP BY node""",
    "suspicious_nodes_inclusive": """
        SELECT node, min_by(rank, rank_no) AS rank, min_by(suspend_seconds, rank_no) AS suspend_seconds
        FROM completed WHERE suspend_seconds > 150000 GROUP BY node""",
    "rank_range_filter": "SELECT l.node, rank, line_no FROM log_text l JOIN ranges g ON l.node = g.node WHERE rank_no >= min_rank AND rank_no < max_rank",
    "missing_ranks": "SELECT node, rank, n_entries AS entries, suspend_seconds, marker FROM completed",
    "rank_logs_nested": f"""
        SELECT s.node, s.rank, CAST(count(e.line_no) AS INTEGER) AS n_entries,
          coalesce(string_agg(coalesce(strftime(e.ts, {RFC}), '') || '|' || e.level || '|' || e.epoch || '|' || e.message, chr(10) ORDER BY e.line_no), '') AS entries,
          s.suspend_seconds, '2024-01-31T00:00:00Z' AS tail_time
        FROM silence s LEFT JOIN (SELECT e.* FROM entries e JOIN tails t ON e.line_no = t.line_no) e ON e.rank = s.rank
        GROUP BY s.node, s.rank, s.suspend_seconds""",
    "rank_log_records": f"""
        SELECT s.rank, coalesce(string_agg(coalesce(strftime(e.ts, {RFC}), '') || '|' || e.level || '|' || e.epoch || '|' || e.message, chr(10) ORDER BY e.line_no), '') AS entries,
          s.suspend_seconds, '2024-01-31T00:00:00Z' AS tail_time, 'allrank' AS selection
        FROM silence s LEFT JOIN (SELECT e.* FROM entries e JOIN tails t ON e.line_no = t.line_no) e ON e.rank = s.rank
        GROUP BY s.rank, s.suspend_seconds""",
    "event_files_read": f"SELECT {EVENT} FROM event_store WHERE NOT starts_with(path, 'rank3_')",
    "event_files_rejected": "SELECT DISTINCT path FROM event_store WHERE starts_with(path, 'rank3_')",
    "node_list": "SELECT DISTINCT node FROM event_store",
    "parser_registry": """
        SELECT rank, line_no, CASE WHEN free THEN 0 ELSE CASE level_text WHEN 'LOG_INFO' THEN 2 WHEN 'LOG_DEBUG' THEN 1
            WHEN 'LOG_WARNING' THEN 3 WHEN 'LOG_ERROR' THEN 4 ELSE 0 END END AS level,
          CASE WHEN free THEN '' ELSE CAST(epoch_no AS VARCHAR) END AS step
        FROM log_text""",
    "rank_filter": "SELECT node, rank, line_no, line FROM log_text WHERE rank = 'RANK3'",
    "rank_compare": """
        SELECT id, CAST(rank_no AS BIGINT) AS number, CAST(sign(rank_no - job_no) AS INTEGER) AS sign FROM (
          SELECT 'e' || event_id AS id, rank_no, user_id % 10 AS job_no FROM labelled)""",
    "highest_rank": "SELECT 'RANK' || max(rank_no) AS rank FROM labelled",
    "rank_order": "SELECT DISTINCT node, rank FROM labelled",
    "oversized_ranks": """
        SELECT node, rank, CAST(max(strlen(line)) AS INTEGER) AS line_bytes FROM log_text GROUP BY node, rank HAVING max(strlen(line)) >= 77""",
    "rank_log_files": """
        SELECT run, rank, CAST(sum(strlen(line) + CASE WHEN run = 'old' THEN 5 ELSE 1 END) AS BIGINT) AS length
        FROM log_text, (SELECT unnest(['old', 'new']) AS run) GROUP BY ALL""",
    "tail_blocks": """
        SELECT node, run, rank, CASE WHEN run = 'old' THEN 'old ' ELSE '' END || line AS line FROM tails, (SELECT unnest(['old', 'new']) AS run)""",
    "newest_run_tail": "SELECT node, rank, n_entries AS entries FROM silence",
    "latest_run_dir": f"""
        SELECT '/runs/job' || job AS work_dir, '/runs/job' || job || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path,
          strftime(o_orderdate, {RFC}) AS mtime
        FROM (SELECT *, o_custkey % 50 AS job FROM orders WHERE o_orderstatus <> 'F')
        QUALIFY row_number() OVER (PARTITION BY job ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "clean_utf8": "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN text || chr(65533) || text ELSE text END AS text FROM documents",
    "extract_nodes": """
        SELECT c_custkey AS job, unnest(['h' || c_custkey, 'h' || c_nationkey]) AS node FROM customer WHERE c_custkey % 13 <> 0""",
    "rank_range_text": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 >= 3 THEN CAST(o_orderkey AS INTEGER) ELSE -1 END AS min_rank,
          CASE WHEN o_orderkey % 5 >= 3 THEN CAST(o_custkey AS INTEGER) ELSE -1 END AS max_rank, o_orderkey % 5 >= 3 AS good FROM orders""",
    "time_bounds": f"""
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, {RFC}) WHEN 1 THEN strftime(o_orderdate, {RFC})
          WHEN 2 THEN strftime(o_orderdate - INTERVAL 8 HOUR, {RFC}) ELSE '' END AS bound FROM orders""",
    "time_range": """
        SELECT o_orderkey, CASE WHEN reason = '' THEN CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE ms END END AS start_ms,
          CASE WHEN reason = '' THEN CASE WHEN o_orderkey % 5 = 0 THEN CAST(1706659200000 AS BIGINT) ELSE ms END END AS end_ms, reason
        FROM (SELECT o_orderkey, epoch_ms(o_orderdate - CASE WHEN o_orderkey % 4 = 2 THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END) AS ms,
            CASE WHEN o_orderkey % 4 < 3 THEN '' WHEN o_orderkey % 3 <> 0 THEN 'Invalid start time format'
              WHEN o_orderkey % 5 <> 0 THEN 'Invalid end time format' ELSE '' END AS reason FROM orders)""",
    "process_tree": "SELECT * FROM tree",
    "process_environ": """
        SELECT node, pid, CASE WHEN worker OR NOT has_rank THEN '' ELSE CAST(rank AS VARCHAR) END AS rank,
          CASE WHEN worker THEN '' ELSE '/root' END AS home FROM procs
        UNION ALL SELECT DISTINCT node, -1000 - pid % 8, '', '' FROM procs""",
    "rank_range": "SELECT node, min(rank) AS min_rank, max(rank) AS max_rank FROM procs WHERE NOT worker AND has_rank GROUP BY node",
    "process_filter": """
        SELECT node, pid, ppid, 2 AS type, 'RANK' || rank AS rank, 'RANK' || local_rank AS local_rank FROM tree WHERE type = 'dataloader'""",
    "process_rank_filter": """
        SELECT node, pid, ppid, CASE type WHEN 'trainer' THEN 1 ELSE 2 END AS type, 'RANK' || rank AS rank, 'RANK' || local_rank AS local_rank
        FROM tree WHERE rank = 17""",
    "process_counts": "SELECT node, CAST(snapshot_no AS INTEGER) AS snapshot_no, count(*) AS total_processes FROM samples GROUP BY ALL",
    "stack_parse": """
        SELECT h.node, h.pid, CAST(h.thread_no - 1 AS INTEGER) AS place,
          CASE WHEN regexp_matches(h.line, 'thread \\d+ \\(') THEN CAST(regexp_extract(h.line, 'thread (\\d+) ', 1) AS INTEGER) ELSE -1 END AS thread_id,
          CASE WHEN regexp_matches(h.line, 'thread \\d+ \\(') THEN regexp_extract(h.line, '\\((.*?)\\)', 1) ELSE 'unknown' END AS thread_name,
          CAST(count(f.frame) AS INTEGER) AS frames, coalesce(string_agg(f.frame, '|' ORDER BY f.frame_no), '') AS stack
        FROM grouped_lines h LEFT JOIN frame_texts f ON f.pid = h.pid AND f.thread_no = h.thread_no
        WHERE h.class = 'thread' GROUP BY h.node, h.pid, h.thread_no, h.line""",
    "stack_reports": """
        SELECT t.node, t.pid, t.ppid, 1 AS type, 'RANK' || t.rank AS rank, 'RANK' || t.local_rank AS local_rank,
          CAST(1 + o.o_custkey % 3 AS INTEGER) AS threads, o.o_orderpriority AS first_thread
        FROM tree t JOIN orders o ON o.o_orderkey = t.pid WHERE t.type = 'trainer'""",
    "previous_snapshot": """
        SELECT node, CAST(snapshot_no AS INTEGER) AS snapshot_no, pid, n_threads AS threads,
          coalesce(CASE WHEN lag(snapshot_no) OVER w = snapshot_no - 1 THEN lag(n_threads) OVER w END, -1) AS previous
        FROM samples WINDOW w AS (PARTITION BY node, pid ORDER BY snapshot_no)""",
    "snapshot_errors": "SELECT node, CAST(snapshot_no AS INTEGER) AS snapshot_no, error FROM pair_errors",
    "snapshot_pairs": "SELECT node, CAST(snapshot_no AS INTEGER) AS snapshot_no, pid, rank_a AS rank, threads_a AS threads, threads_b AS previous FROM pairs",
    "stack_diff": "SELECT node, CAST(snapshot_no AS INTEGER) AS snapshot_no, pid, rank, type, diff FROM diffs",
    "snapshot_verdict": "SELECT * FROM verdicts",
    "suspect_stacks": """
        SELECT node, CAST(snapshot_no AS INTEGER) AS snapshot_no, pid, rank FROM samples
        WHERE node IN (SELECT node FROM silence WHERE suspend_seconds > 150000)""",
    "hang_verdicts": """
        SELECT v.node, s.rank, s.suspend_seconds, v.snapshot_no, v.verdict, v.diffs, v.error FROM verdicts v JOIN (
          SELECT node, min_by(rank, rank_no) AS rank, min_by(suspend_seconds, rank_no) AS suspend_seconds
          FROM completed WHERE suspend_seconds > 150000 GROUP BY node) s ON s.node = v.node""",
    "snapshot_files": """
        SELECT node, check_id, CAST(s AS INTEGER) AS snapshot_no, snapshot_time, CAST(o_orderkey AS INTEGER) AS pid,
          'RANK' || ((o_orderkey // 24) % 64) AS rank, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS type,
          'File "mod' || (o_custkey % 97) || '.py", line ' || (c * 100 + 1) AS first_frame, 'File "step.py", line ' || step AS second_frame
        FROM check_samples WHERE NOT bare AND NOT broken""",
    "snapshot_samples": "SELECT node, check_id, snapshot_no, snapshot_time, n_processes FROM check_facts",
    "snapshot_rejects": "SELECT DISTINCT node, snapshot_time, '{\"processes\":[' AS beginning FROM check_samples WHERE broken",
    "check_verdicts": """
        SELECT a.node, a.check_id, a.snapshot_no, CASE WHEN a.n_processes = b.n_processes AND coalesce(d.n, 0) = 0 THEN 'noDiff' ELSE 'haveDiff' END AS verdict,
          CASE WHEN a.n_processes = b.n_processes THEN coalesce(d.n, 0) ELSE 0 END AS diffs,
          CASE WHEN a.n_processes <> b.n_processes THEN 'process count mismatch: psa: ' || a.n_processes || ', psb: ' || b.n_processes ELSE '' END AS error
        FROM check_facts a JOIN check_facts b ON a.node = b.node AND a.check_id = b.check_id AND a.snapshot_no = b.snapshot_no + 1
        LEFT JOIN (SELECT node, count(DISTINCT o_orderkey) AS n FROM check_samples WHERE step > 0 GROUP BY node) d ON d.node = a.node""",
    "event_filter": f"SELECT {EVENT} FROM event_store WHERE {IN_WINDOW}",
    "event_store_day": f"SELECT {EVENT} FROM event_store WHERE {IN_WINDOW}",
    "event_store_pruned": f"SELECT {EVENT} FROM event_store WHERE {IN_WINDOW}",
    "event_index_stored": """
        SELECT CAST(make_timestamp("timestamp" * 1000) AS DATE) AS event_date, min("timestamp") AS min_time, max("timestamp") AS max_time,
          max(severity) AS max_severity, count(*) AS events
        FROM event_store GROUP BY 1""",
    "event_defaults": """
        SELECT CASE WHEN even THEN sha256(path || '/' || job_id || '/' || processed_at || '/' || message) ELSE id END AS id,
          CASE WHEN even THEN 'alert' ELSE type END AS type,
          CASE WHEN severity = 3 THEN 1706659200000 ELSE "timestamp" END AS "timestamp", message
        FROM (SELECT *, "timestamp" % 2 = 0 AS even FROM event_store)""",
    "event_payload": """
        SELECT conv_id, turn, 'trainning' AS source, 'alert' AS type, 0 AS severity, conv_id % 5 IN (1, 2) AS rejected,
          CASE WHEN conv_id % 5 IN (1, 2) THEN '' ELSE text END AS message FROM conversations""",
    "event_latest": 'SELECT id, "timestamp", message FROM event_store ORDER BY "timestamp" DESC, id',
    "alert_records": """
        SELECT id, message, "timestamp" * 1000 AS micros, CASE severity WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' ELSE 'CRITICAL' END AS severity,
          severity AS code FROM event_store""",
    "event_file_index": """
        SELECT path, min("timestamp") AS min_time, max("timestamp") AS max_time, max(severity) AS max_severity,
          string_agg(DISTINCT type, ',' ORDER BY type) AS event_types, bool_and(processed) AS all_processed
        FROM event_store GROUP BY path""",
    "event_file_prune": """
        SELECT path, id FROM event_store WHERE path IN (
          SELECT path FROM event_store GROUP BY path HAVING max("timestamp") >= 1704412800000 AND min("timestamp") <= 1705708800000
            AND max(severity) >= 1 AND bool_or(type = 'alert') AND NOT bool_and(processed))""",
    "apply_processed": "SELECT id, processed, processed_at FROM marked",
    "unprocessed_alerts": """SELECT node, id, "timestamp", severity FROM marked WHERE type = 'alert' AND NOT processed""",
    "alert_window": """
        SELECT node, id, "timestamp", severity FROM event_store WHERE "timestamp" BETWEEN 1705276800000 AND 1706659200000
          AND severity >= 1 AND type = 'alert' AND NOT processed""",
    "alert_rollup": "SELECT node, n AS alert_count, coalesce(error, '') AS error, error IS NULL AND n = 0 AS no_alert FROM rollup",
    "alert_numbering": 'SELECT node, id, "timestamp", row_number() OVER (PARTITION BY node ORDER BY "timestamp" DESC, id) AS alert_no FROM event_store',
    "alert_messages": f"""
        SELECT node, part, text, text AS sent FROM (
          SELECT r.node, coalesce(l.part, 0) AS part, {MESSAGE_HEAD} || CASE WHEN r.error IS NOT NULL
              THEN 'Status: Failed' || chr(10) || 'Error message: ' || r.error || chr(10)
              ELSE 'Status: Found ' || r.n || ' alerts' || chr(10) || l.body END AS text
          FROM rollup r LEFT JOIN (
            SELECT node, (no - 1) // 500 AS part, string_agg(no || '. Time: ' || strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d %H:%M:%S.%g') || chr(10) ||
              '   Level: ' || CASE severity WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' ELSE 'CRITICAL' END || chr(10) ||
              '   Message: ' || message || chr(10), '' ORDER BY no) AS body
            FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY "timestamp" DESC, id) AS no FROM polled) GROUP BY ALL) l
            ON l.node = r.node AND r.error IS NULL
          WHERE r.error IS NOT NULL OR r.n > 0)""",
    "alert_marks": "SELECT id, true AS processed, 1706659200000 AS processed_at, CAST(7 AS BIGINT) AS seq FROM polled WHERE node IN (SELECT node FROM asked WHERE error IS NULL)",
    "version_report": """
        SELECT string_agg(DISTINCT version, ',' ORDER BY version) AS versions, count(DISTINCT version) > 1 AS mismatch,
          count(version) = 0 AS "none" FROM agents WHERE error IS NULL""",
    "version_counts": "SELECT version, count(*) AS nodes FROM agents WHERE error IS NULL GROUP BY version",
    "failure_summary": "SELECT op, count(error) AS failed, count(*) - count(error) AS succeeded FROM answers GROUP BY op",
    "failure_messages": "SELECT op, node, 'Node ' || node || ': ' || error AS message FROM answers WHERE error IS NOT NULL",
    "union_results": "SELECT op, node, coalesce(version, '') AS version FROM answers",
    "distinct_nodes": "SELECT DISTINCT node FROM samples",
    "request_totals": "SELECT method, status, count(*) AS requests FROM rpc GROUP BY ALL",
    "request_totals_by_instance": "SELECT method, status, instance, count(*) AS requests FROM rpc GROUP BY ALL",
    "latency_histogram": f"""
        SELECT method, le, count(*) FILTER (le = '+Inf' OR duration <= TRY_CAST(le AS DOUBLE)) AS requests,
          CAST(CAST(sum(CAST(duration AS DECIMAL(28, 9))) AS DECIMAL(38, 9)) AS VARCHAR) AS duration_sum, count(*) AS duration_count
        FROM rpc, (VALUES {BUCKETS}) b(le) GROUP BY method, le""",
    "stream_hang": f"""
        SELECT node, rank, strftime(last_line, {RFC}) AS last_line, lines FROM (
          SELECT node, rank, session, max(ts) AS last_line, count(*) AS lines FROM (
            SELECT *, sum(CASE WHEN before IS NULL OR date_diff('second', before, ts) >= 7201 THEN 1 ELSE 0 END)
              OVER (PARTITION BY rank ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING) AS session
            FROM (SELECT *, lag(ts) OVER (PARTITION BY rank ORDER BY ts, line_no) AS before FROM entries WHERE ts IS NOT NULL))
          GROUP BY ALL)
        WHERE last_line + INTERVAL 7201 SECOND <= (SELECT max(ts) FROM entries)""",
    "stream_hang_batches": f"""
        SELECT node, rank, strftime(last_line, {RFC}) AS last_line, CAST(lines AS BIGINT) AS lines FROM (
          SELECT node, rank, session, max(ts) AS last_line, sum(line) AS lines FROM (
            SELECT *, sum(CASE WHEN before IS NULL OR date_diff('second', before, ts) >= 7201 THEN 1 ELSE 0 END)
              OVER (PARTITION BY rank ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING) AS session
            FROM (SELECT *, lag(ts) OVER (PARTITION BY rank ORDER BY ts, line_no) AS before FROM (
              SELECT node, rank, ts, line_no, 1 AS line FROM entries WHERE ts IS NOT NULL
              UNION ALL SELECT node, rank, (SELECT date_trunc('day', min(ts) - INTERVAL 30 DAY) FROM events), -1, 0 FROM expected)))
          GROUP BY ALL)""",
    "stream_alerts": """SELECT id, node, "timestamp", severity FROM event_store WHERE severity >= 1 AND type = 'alert' AND NOT processed""",
    "stream_ingest": """
        SELECT sha256('{"msg_type":"text","content":{"text":"' || event_type || '"}}' || chr(0) || event_id) AS id, 'trainning' AS source,
          'alert' AS type, event_type AS message, 1706659200000 AS "timestamp", false AS processed FROM events WHERE event_type <> 'error'""",
    "stream_mark_processed": """
        SELECT id, processed OR hit AS processed, CASE WHEN hit THEN 1706659200000 ELSE processed_at END AS processed_at FROM (
          SELECT *, severity >= 1 AND type = 'alert' AND NOT processed AS hit FROM event_store)""",
    "stream_metrics": f"""
        SELECT strftime(day, {RFC}) AS start, method, status, requests,
          CAST(sum(requests) OVER (PARTITION BY method, status ORDER BY day) AS BIGINT) AS total
        FROM (SELECT date_trunc('day', ts) AS day, method, status, count(*) AS requests FROM rpc GROUP BY ALL)""",
    "stream_alerts_ledger": """
        SELECT id, node, "timestamp", severity, CASE WHEN severity >= 2 THEN 'a' ELSE 'b' END AS told_by, true AS processed,
          CAST(1706659200000 AS BIGINT) AS processed_at
        FROM event_store WHERE severity >= 1 AND type = 'alert' AND NOT processed""",
    "stream_ingest_rejects": """
        SELECT sha256(body || chr(0) || event_id) AS id, epoch_us(ts) // 1000 AS "timestamp",
          CASE WHEN event_type = 'error' THEN 'bad ' || body ELSE event_type END AS message
        FROM (SELECT *, '{"MSG_TYPE":"text","Content":{"text":"first","Text":"' || event_type || CASE WHEN event_type = 'error' THEN '' ELSE '"' END || '}}' AS body
              FROM events)""",
}


def _needed(body: str, seen: list[str]) -> list[str]:
    """Views a statement names, each after the ones it is built on."""
    import re
    for name in VIEWS:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s", body):
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def statement(name: str) -> str:
    views = _needed(BODIES[name], [])
    ctes = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in views)
    return f"WITH {ctes}\n{BODIES[name]}" if views else BODIES[name]


def statements() -> dict[str, str]:
    return {name: statement(name) for name in BODIES}
