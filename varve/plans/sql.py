"""DuckDB SQL of the registered queries."""

from __future__ import annotations

_LOG = "log AS (SELECT user_id AS key, epoch_us(ts) * 1000 AS commit_ts, value, event_type = 'error' AS is_deleted FROM events)"
_SEEN = "seen AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) AS rn FROM log WHERE commit_ts <= 1705000000000000000)"
_LIVE = f"{_LOG}, {_SEEN}, live AS (SELECT key, commit_ts, value FROM seen WHERE rn = 1 AND NOT is_deleted)"
_ACTS = """acts AS (SELECT event_id AS txn, user_id AS key, epoch_us(ts) * 1000 AS commit_ts, value,
  CASE event_type WHEN 'signup' THEN 'Insert' WHEN 'click' THEN 'Upsert' WHEN 'purchase' THEN 'Update' WHEN 'error' THEN 'Delete' ELSE 'Read' END AS kind FROM events),
before AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('Insert', 'Upsert') THEN true WHEN kind = 'Delete' THEN false END IGNORE NULLS)
  OVER (PARTITION BY key ORDER BY commit_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS existed FROM acts),
done AS (SELECT *, CASE WHEN kind = 'Insert' AND existed THEN 'KeyAlreadyExists'
  WHEN kind IN ('Update', 'Delete', 'Read') AND NOT existed THEN 'KeyNotFound' ELSE 'Success' END AS code FROM before)"""
_VERTEX = "printf('%08X', {t}) || printf('%08X', strlen({v})) || hex({v})"
_EDGES = """edges AS (SELECT DISTINCT * FROM (
  SELECT 1 AS head_type, CAST(o_custkey AS VARCHAR) AS head_value, 1 AS type, 4 AS tail_type, CAST(o_orderkey AS VARCHAR) AS tail_value FROM orders
  UNION ALL SELECT 4, CAST(l_orderkey AS VARCHAR), 2, 3, CAST(l_partkey AS VARCHAR) FROM lineitem))"""
_VERTICES = """vertices AS (SELECT 1 AS type, CAST(c_custkey AS VARCHAR) AS value FROM customer UNION ALL SELECT 2, CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 3, CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 4, CAST(o_orderkey AS VARCHAR) FROM orders)"""
_STATUS = """status AS (SELECT o_orderkey AS txn, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'Decided' WHEN o_orderstatus = 'F' THEN 'Committed' WHEN o_orderstatus = 'O' THEN 'Prepared' WHEN o_orderstatus = 'P' THEN 'Timedout' END AS state,
  o_custkey % 2 = 0 AS locks_released, epoch_us(o_orderdate) * 1000 AS ts FROM orders)"""
_REPLICAS = """replicas AS (SELECT o_custkey % 50 AS pid, o_orderkey AS replica, o_orderkey % 9 AS server,
  CASE o_orderkey % 5 WHEN 1 THEN 'NonVoter' WHEN 2 THEN 'Joining' WHEN 3 THEN 'Leaving' ELSE 'Voter' END AS state, 'r' || o_orderkey AS name, 'r' || o_orderkey AS leader,
  o_orderkey AS term, o_custkey AS applied, o_custkey + o_orderkey % 7 AS committed, epoch_us(o_orderdate) * 1000 AS created FROM orders)"""
_OPS = """ev AS (SELECT event_id AS txn, CASE WHEN event_type = 'view' THEN 'r' ELSE 'w' END AS op, user_id AS key, epoch_us(ts) * 1000 AS commit_ts FROM events),
seen AS (SELECT *, last_value(CASE WHEN op = 'w' THEN txn END IGNORE NULLS) OVER (PARTITION BY key ORDER BY commit_ts, txn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
  first_value(CASE WHEN op = 'w' THEN txn END IGNORE NULLS) OVER (PARTITION BY key ORDER BY commit_ts, txn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM ev),
older AS (SELECT *, last_value(CASE WHEN op = 'w' THEN last END IGNORE NULLS) OVER (PARTITION BY key ORDER BY commit_ts, txn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_last FROM seen),
ops AS (SELECT txn, op, key, CASE WHEN op = 'w' THEN txn WHEN txn % 4 = 0 THEN last WHEN txn % 4 = 1 THEN before_last WHEN txn % 4 = 3 THEN next END AS value, commit_ts FROM older)"""
_EDGES_OF = f"""{_OPS}, w AS (SELECT key, txn, value, lead(txn) OVER (PARTITION BY key ORDER BY commit_ts, txn) AS next_txn FROM ops WHERE op = 'w'),
deps AS (SELECT DISTINCT * FROM (SELECT txn AS src, next_txn AS dst, 'ww' AS kind FROM w WHERE next_txn IS NOT NULL UNION ALL SELECT w.txn, r.txn, 'wr' FROM ops r JOIN w ON w.key = r.key AND w.value = r.value WHERE r.op = 'r'
  UNION ALL SELECT r.txn, w.next_txn, 'rw' FROM ops r JOIN w ON w.key = r.key AND w.value = r.value WHERE r.op = 'r' AND next_txn IS NOT NULL
  UNION ALL SELECT r.txn, f.txn, 'rw' FROM ops r JOIN (SELECT key, arg_min(txn, (commit_ts, txn)) AS txn FROM ops WHERE op = 'w' GROUP BY 1) f ON f.key = r.key WHERE r.op = 'r' AND r.value IS NULL) WHERE src <> dst)"""
_VLOG = """vlog AS (SELECT c_custkey AS id, c_custkey + 1000 AS commit_ts, c_name AS payload, false AS is_deleted FROM customer UNION ALL SELECT c_custkey, 500000, NULL, true FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, 600000, c_name || '*', false FROM customer WHERE c_custkey % 21 = 0)"""
_ELOG = """elog AS (SELECT o_custkey AS head, o_orderkey AS id, o_orderkey + 2000 AS commit_ts, o_orderstatus AS payload, false AS is_deleted FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 500000, NULL, true FROM orders WHERE o_orderkey % 3 = 0)"""
_VREQ = """req AS (SELECT id, unnest(CASE WHEN id % 10 = 0 THEN [0, 1] ELSE [0] END) AS pos FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS id FROM customer)),
now AS (SELECT id, arg_max(is_deleted, commit_ts) AS is_deleted FROM vlog WHERE commit_ts < 550000 GROUP BY 1), live AS (SELECT id FROM now WHERE NOT is_deleted)"""
_EREQ = """req AS (SELECT o_custkey AS head, o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 1000000 ELSE 0 END AS id FROM orders),
live AS (SELECT head, id FROM (SELECT head, id, arg_max(is_deleted, commit_ts) AS gone FROM elog WHERE commit_ts < 550000 GROUP BY ALL) WHERE NOT gone)"""
_PLACED = """placed AS (SELECT s_suppkey AS pid, (s_suppkey * 7 + i * 3) % 13 AS server, ['Voter', 'NonVoter', 'Voter', 'Joining', 'Voter', 'Leaving'][(s_suppkey + i * 2) % 6 + 1] AS state, (s_suppkey + i) % 2 = 0 AS ready,
  s_suppkey * 10 + (i * 3) % 5 AS created FROM (SELECT s_suppkey, unnest(range(0, s_suppkey % 5 + 1)) AS i FROM supplier)),
sload AS (SELECT server, count(*) FILTER (state <> 'Leaving') AS total, count(*) FILTER (state = 'Joining') AS joining FROM placed GROUP BY 1),
pload AS (SELECT pid, count(*) FILTER (state <> 'Leaving') AS total, count(*) FILTER (state = 'Joining') AS joining, count(*) FILTER (state IN ('Voter', 'NonVoter')) AS serving FROM placed GROUP BY 1),
pairs AS (SELECT s_suppkey AS pid, s.server, coalesce(p.total, 0) AS p_total, coalesce(p.joining, 0) AS p_joining, coalesce(l.total, 0) AS s_total, coalesce(l.joining, 0) AS s_joining
  FROM supplier CROSS JOIN (SELECT unnest(range(14)) AS server) s LEFT JOIN pload p ON p.pid = s_suppkey LEFT JOIN sload l ON l.server = s.server
  WHERE NOT EXISTS (SELECT 1 FROM placed x WHERE x.pid = s_suppkey AND x.server = s.server))"""
_SAFE = """prepared AS (SELECT user_id AS key, min(epoch_us(ts) * 1000) AS first FROM events WHERE event_type <> 'view' AND epoch_us(ts) * 1000 > 1705000000000000000 GROUP BY 1),
safe AS (SELECT DISTINCT e.user_id AS id, least(1800000000000000000, first - 1) AS safe_ts FROM events e LEFT JOIN prepared p ON p.key = e.user_id)"""

_KIND = "CASE event_type WHEN 'signup' THEN 'Insert' WHEN 'click' THEN 'Upsert' WHEN 'purchase' THEN 'Update' WHEN 'error' THEN 'Delete' ELSE 'Read' END"
_GROUPED = f"""g AS (SELECT user_id || '-' || (cts // 10800000000000) AS txn, user_id AS owner, user_id || '/' || chr(CAST(97 + event_id % 10 AS INTEGER)) AS key, user_id || '/' || chr(CAST(100 + event_id % 10 AS INTEGER)) AS hi,
  chr(CAST(97 + event_id % 10 AS INTEGER)) AS letter, chr(CAST(100 + event_id % 10 AS INTEGER)) AS end_letter, cts // 10800000000000 * 10800000000000 AS commit_ts, event_id AS action_id,
  CASE WHEN event_id % 11 = 0 THEN 'LockKey' WHEN event_id % 13 = 0 THEN 'LockRange' ELSE {_KIND} END AS kind,
  CASE WHEN event_id % 11 = 0 THEN ['MustExist', 'MustNotExist', 'None'][event_id // 7 % 3 + 1] WHEN event_id % 13 = 0 THEN ['MustBeEmpty', 'MustNotBeEmpty', 'None'][event_id // 7 % 3 + 1] END AS chk
  FROM (SELECT *, epoch_us(ts) * 1000 AS cts FROM events))"""
_LOCKS = f"""{_GROUPED}, locks AS (SELECT txn, owner, action_id, key AS lo, CASE WHEN kind = 'LockRange' THEN hi ELSE key || '+' END AS hi, letter, CASE WHEN kind = 'LockRange' THEN end_letter ELSE letter || chr(1) END AS end_letter,
  CASE WHEN kind IN ('LockKey', 'LockRange') THEN action_id % 2 = 0 ELSE kind <> 'Read' END AS exclusive FROM g)"""
_COMMANDS = """cmd AS (SELECT txn, seq, CASE WHEN seq = 1 THEN CASE l_suppkey % 8 WHEN 0 THEN 'Abort' WHEN 1 THEN 'Autocommit' ELSE 'Prepare' END
  ELSE ['Commit', 'Abort', 'StoreDecision', 'MarkTimedout', 'Prepare', 'Commit', 'MarkTimedout', 'StoreDecision'][l_partkey % 8 + 1] END AS command, l_suppkey + seq * 4 AS x_ts, l_linenumber % 3 <> 0 AS x_commit,
  l_linenumber % 2 = 0 AS x_release, l_orderkey % 5 <> 0 AS principal, l_partkey % 9 = 0 AS refused
  FROM (SELECT *, l_orderkey AS txn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem))"""
_MACHINE = f"""{_COMMANDS}, m(txn, seq, command, state, ts, prepared, dec, dec_ts, released, result, error) AS (
  SELECT DISTINCT txn, CAST(0 AS BIGINT), '', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), false, CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT), false, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM cmd
  UNION ALL
  SELECT txn, seq, command, CASE WHEN moves THEN target ELSE state END, CASE WHEN moves THEN x_ts ELSE ts END, prepared OR (moves AND command = 'Prepare'), CASE WHEN moves AND command = 'StoreDecision' THEN x_commit ELSE dec END,
    CASE WHEN moves AND command = 'StoreDecision' THEN x_ts ELSE dec_ts END, released OR (moves AND command IN ('Commit', 'Abort', 'Autocommit')) OR (error IS NULL AND command = 'MarkTimedout' AND coalesce(state, '') = 'Timedout' AND x_release),
    CASE WHEN error IS NULL THEN CASE WHEN no THEN 'Failed' WHEN moves THEN target ELSE state END END, error
  FROM (SELECT *, error IS NULL AND NOT no AND (state IS NULL OR state = 'Prepared' AND command <> 'Prepare' OR state = 'Decided' AND command = 'Commit') AS moves
    FROM (SELECT m.txn, cmd.seq, cmd.command, m.state, m.ts, m.prepared, m.dec, m.dec_ts, m.released, x_ts, x_commit, x_release, m.state IS NULL AND refused AS no,
      CASE cmd.command WHEN 'Prepare' THEN 'Prepared' WHEN 'Abort' THEN 'Aborted' WHEN 'StoreDecision' THEN 'Decided' WHEN 'MarkTimedout' THEN 'Timedout' ELSE 'Committed' END AS target,
      CASE WHEN m.state IS NULL THEN CASE WHEN cmd.command NOT IN ('Prepare', 'Autocommit') THEN 'NotFound' END
        WHEN cmd.command = 'Prepare' THEN CASE WHEN m.state <> 'Prepared' THEN 'FailedPrecondition' END
        WHEN cmd.command = 'Autocommit' THEN CASE WHEN m.state <> 'Committed' THEN 'FailedPrecondition' END
        WHEN cmd.command IN ('StoreDecision', 'MarkTimedout') AND NOT principal THEN 'PermissionDenied'
        WHEN NOT m.prepared THEN 'NotFound'
        WHEN cmd.command = 'Commit' THEN CASE m.state WHEN 'Committed' THEN NULL WHEN 'Decided' THEN CASE WHEN x_ts <> m.dec_ts THEN 'InvalidRequest' END WHEN 'Prepared' THEN CASE WHEN x_ts < m.ts THEN 'InvalidRequest' END ELSE 'FailedPrecondition' END
        WHEN cmd.command = 'Abort' THEN CASE WHEN m.state NOT IN ('Aborted', 'Timedout', 'Prepared') THEN 'FailedPrecondition' END
        WHEN cmd.command = 'StoreDecision' THEN CASE m.state WHEN 'Decided' THEN CASE WHEN x_commit <> m.dec THEN 'FailedPrecondition' END WHEN 'Timedout' THEN NULL WHEN 'Prepared' THEN CASE WHEN x_ts < m.ts THEN 'InvalidRequest' END ELSE 'FailedPrecondition' END
        ELSE CASE WHEN m.state NOT IN ('Timedout', 'Prepared') THEN 'FailedPrecondition' END END AS error
      FROM m JOIN cmd ON cmd.txn = m.txn AND cmd.seq = m.seq + 1)))"""
_BATCHES = """a AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY ts, seq) AS n FROM (SELECT user_id % 16 AS "partition", event_id AS seq, epoch_us(ts) * 1000 // 1000000 AS ts,
  ['Abort', 'MarkTimedout', 'Commit', 'Autocommit', 'Prepare', 'StoreDecision'][event_id % 6 + 1] AS command FROM events)),
b("partition", n, seq, first, size, batch) AS (SELECT DISTINCT "partition", CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 100, CAST(-1 AS BIGINT) FROM a
  UNION ALL SELECT a."partition", a.n, a.seq, CASE WHEN size >= 100 OR ts - first >= 10000000 THEN ts ELSE first END, CASE WHEN size >= 100 OR ts - first >= 10000000 THEN 1 ELSE size + 1 END,
    CASE WHEN size >= 100 OR ts - first >= 10000000 THEN batch + 1 ELSE batch END FROM b JOIN a ON a."partition" = b."partition" AND a.n = b.n + 1)"""

# XXH64 with seed 0 of keys of less than 8 bytes: its primes, and 64-bit arithmetic in 128 bits
_P1, _P2, _P3, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 2870177450012600261
_U = lambda x: f"CAST({x} AS UHUGEINT)"
_MUL = lambda a, b: f"(({_U(a)} * {_U(b)}) % {_U(1 << 64)})"
_XOR = lambda a, b: f"CAST(xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT)) AS UHUGEINT)"
_ROT = lambda x, r: f"(({x} * {_U(1 << r)}) % {_U(1 << 64)} + {x} // {_U(1 << (64 - r))})"
_ADD = lambda a, b: f"(({a} + {_U(b)}) % {_U(1 << 64)})"


def _xxh(rows: str) -> str:
    """CTEs that end in h5(*, h): ``rows`` (with a column k, a string) and the hash of k."""
    byte = "unicode(substr(k, {}, 1))"
    lane = " + ".join(f"{byte.format(i + 1)} * {256**i}" for i in range(4))
    return f"""h0 AS (SELECT *, {_ADD(_U("length(k)"), _P5)} AS h FROM ({rows})),
h1 AS (SELECT * REPLACE (CASE WHEN length(k) >= 4 THEN {_XOR("h", _MUL(lane, _P1))} ELSE h END AS h) FROM h0),
h2 AS (SELECT * REPLACE (CASE WHEN length(k) >= 4 THEN {_ADD(_MUL(_ROT("h", 23), _P2), _P3)} ELSE h END AS h) FROM h1),
h3 AS (SELECT * REPLACE (list_reduce(list_prepend(h, list_transform(range(CASE WHEN length(k) >= 4 THEN 5 ELSE 1 END, length(k) + 1), lambda i: {_U(byte.format("i"))})),
  lambda x, b: {_MUL(_ROT(_XOR("x", _MUL("b", _P5)), 11), _P1)}) AS h) FROM h2),
h4 AS (SELECT * REPLACE ({_MUL(_XOR("h", f"h // {_U(1 << 33)}"), _P2)} AS h) FROM h3),
h5 AS (SELECT * REPLACE ({_XOR("x", f"x // {_U(1 << 32)}")} AS h) FROM (SELECT *, {_MUL(_XOR("h", f"h // {_U(1 << 29)}"), _P3)} AS x FROM h4))"""


SQL = {
    "txn_fold": f"""WITH RECURSIVE {_GROUPED}, t AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY commit_ts, txn) AS n FROM (SELECT owner, txn, commit_ts,
          list({{'a': action_id, 'kind': kind, 'key': key, 'hi': hi, 'chk': chk}} ORDER BY action_id) AS acts FROM g GROUP BY owner, txn, commit_ts)),
        f(owner, n, live, txn, commit_ts, code, failed_action) AS (SELECT DISTINCT owner, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), '', CAST(0 AS BIGINT), '', CAST(NULL AS BIGINT) FROM t
          UNION ALL SELECT owner, n, CASE WHEN bad IS NOT NULL THEN live ELSE list_concat(list_filter(live, lambda k: NOT list_contains(touched, k)),
              list_filter(list_distinct(touched), lambda k: list_filter(acts, lambda x: x.key = k AND x.kind IN ('Insert', 'Update', 'Upsert', 'Delete'))[-1].kind <> 'Delete')) END, txn, commit_ts,
            CASE WHEN bad IS NULL THEN 'Success' WHEN bad.kind = 'Insert' THEN 'KeyAlreadyExists' WHEN bad.kind IN ('Update', 'Delete') THEN 'KeyNotFound' ELSE 'LockCheckFailed' END, bad.a
          FROM (SELECT f.owner, t.n, f.live, t.txn, t.commit_ts, t.acts, list_transform(list_filter(t.acts, lambda x: x.kind IN ('Insert', 'Update', 'Upsert', 'Delete')), lambda x: x.key) AS touched,
              list_filter(t.acts, lambda x: coalesce(CASE WHEN x.kind = 'Insert' OR x.chk = 'MustNotExist' THEN list_contains(f.live, x.key) WHEN x.kind IN ('Update', 'Delete') OR x.chk = 'MustExist' THEN NOT list_contains(f.live, x.key)
                WHEN x.chk = 'MustBeEmpty' THEN len(list_filter(f.live, lambda k: k >= x.key AND k < x.hi)) > 0 WHEN x.chk = 'MustNotBeEmpty' THEN len(list_filter(f.live, lambda k: k >= x.key AND k < x.hi)) = 0 END, false))[1] AS bad
            FROM f JOIN t ON t.owner = f.owner AND t.n = f.n + 1))
        SELECT txn, commit_ts, code, failed_action FROM f WHERE n > 0""",
    "txn_validate": f"""WITH {_LOG}, iv AS (SELECT key, commit_ts AS f, lead(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts) AS t, is_deleted FROM log),
        a AS (SELECT o_orderkey AS txn, i AS action_id, ['Insert', 'Update', 'Upsert', 'Delete', 'LockKey', 'LockRange', 'Read'][(o_orderkey + i * 3) % 7 + 1] AS kind, (o_custkey + i * 17) % 200 AS key,
          (o_custkey + i * 17) % 200 + o_orderkey % 3 AS hi, 1704067200000000000 + o_custkey * 1000000000000 AS commit_ts FROM orders, (SELECT unnest(range(3)) AS i)),
        b AS (SELECT *, CASE kind WHEN 'LockKey' THEN ['MustExist', 'MustNotExist', 'None'][txn % 3 + 1] WHEN 'LockRange' THEN ['MustNotBeEmpty', 'MustBeEmpty', 'None'][txn % 3 + 1] ELSE '' END AS chk, row_number() OVER () AS id FROM a),
        there AS (SELECT DISTINCT id FROM b JOIN iv ON iv.key >= b.key AND iv.key < CASE WHEN kind = 'LockRange' THEN b.hi ELSE b.key + 1 END WHERE NOT is_deleted AND f <= commit_ts - 1 AND coalesce(t > commit_ts - 1, true)),
        x AS (SELECT *, id IN (SELECT id FROM there) AS found FROM b),
        y AS (SELECT *, CASE WHEN kind = 'Insert' AND found THEN 'KeyAlreadyExists' WHEN kind IN ('Update', 'Delete') AND NOT found THEN 'KeyNotFound' WHEN chk IN ('MustExist', 'MustNotBeEmpty') AND NOT found THEN 'LockCheckFailed'
          WHEN chk IN ('MustNotExist', 'MustBeEmpty') AND found THEN 'LockCheckFailed' END AS why FROM x)
        SELECT txn, commit_ts, coalesce(arg_min(why, action_id) FILTER (why IS NOT NULL), 'Success') AS code, min(action_id) FILTER (why IS NOT NULL) AS failed_action FROM y GROUP BY txn, commit_ts""",
    "txn_apply": f"WITH RECURSIVE {_MACHINE} SELECT txn, seq, command, result AS state, error FROM m WHERE seq > 0",
    "txn_final_status": f"WITH RECURSIVE {_MACHINE} SELECT txn, arg_max(state, seq) AS state, arg_max(ts, seq) AS ts, arg_max(released, seq) AS locks_released FROM m WHERE state IS NOT NULL GROUP BY txn",
    "txn_route": f"""WITH {_xxh("SELECT o_custkey AS txn, o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS k FROM orders")}, p AS (SELECT txn, pos, CAST(h % 16 AS BIGINT) AS pid FROM h5)
        SELECT txn, pos, pid, row_number() OVER (PARTITION BY txn ORDER BY pos) - 1 AS action_id, first_value(pid) OVER (PARTITION BY txn ORDER BY pos) AS principal, n AS participants
        FROM p JOIN (SELECT txn, count(DISTINCT pid) AS n FROM p GROUP BY 1) USING (txn)""",
    "partition_ids": f"""WITH {_xxh("SELECT event_id, CAST(user_id AS VARCHAR) AS k FROM events")} SELECT event_id, CAST(h % 16 AS BIGINT) AS pid FROM h5""",
    "txn_results": f"""WITH {_ACTS}, e AS (SELECT *, CASE code WHEN 'KeyNotFound' THEN 'NotFound' WHEN 'KeyAlreadyExists' THEN 'AlreadyExists' END AS error FROM done)
        SELECT key AS txn, count(*) AS n_actions, count(error) AS n_failed, string_agg(code, ',' ORDER BY txn) AS codes, coalesce(array_to_string(list_sort(list_distinct(list(error))), ','), '') AS errors FROM e GROUP BY 1""",
    "txn_batches": f"""WITH RECURSIVE {_BATCHES} SELECT a."partition", a.seq, ts, command, batch, CAST(list_position(['Abort', 'MarkTimedout', 'Commit', 'Autocommit', 'Prepare', 'StoreDecision'], command) AS BIGINT) AS apply
        FROM a JOIN b ON a."partition" = b."partition" AND a.n = b.n""",
    "txn_stamp": f"""WITH RECURSIVE {_BATCHES}, c AS (SELECT a."partition", a.seq, ts, command, batch, command = 'Commit' AS own FROM a JOIN b ON a."partition" = b."partition" AND a.n = b.n)
        SELECT "partition", seq, CASE WHEN own THEN ts ELSE min(ts) OVER (PARTITION BY "partition", batch) + row_number() OVER (PARTITION BY "partition", batch, own
          ORDER BY list_position(['Autocommit', 'Prepare', 'Abort', 'StoreDecision', 'MarkTimedout'], command), seq) END AS stamp FROM c""",
    "txn_max_timestamp": "SELECT max(epoch_us(ts) * 1000 // 1000000) AS max_timestamp FROM events",
    "txn_read_only_collectable": "SELECT event_id AS txn, epoch_us(ts) * 1000 AS prepared_ts FROM events WHERE event_type = 'view' AND epoch_us(ts) * 1000 < 1705000000000000000 - 5000000000",
    "kv_locks": f"WITH {_LOCKS} SELECT txn, action_id, lo, hi, exclusive FROM locks",
    "txn_restore": f"WITH {_LOCKS} SELECT txn, count(*) AS n_locks, count(*) FILTER (exclusive) AS n_exclusive FROM locks GROUP BY 1 HAVING min(action_id) % 3 <> 0",
    "kv_binary_lock_conflicts": f"""WITH {_LOCKS} SELECT a.action_id AS requested_id, b.action_id AS held_id FROM locks a JOIN locks b ON a.owner // 2 = b.owner // 2 AND a.letter < b.end_letter AND a.end_letter > b.letter
        AND (a.exclusive OR b.exclusive) WHERE a.action_id % 2 = 0 AND b.action_id % 2 = 1""",
    "kv_held_locks": f"WITH {_LOCKS}, t AS (SELECT count(*) AS n FROM locks GROUP BY txn HAVING min(action_id) % 3 <> 0) SELECT CAST(sum(n) AS BIGINT) AS locks_held FROM t",
    "kv_admission": f"""WITH {_SAFE} SELECT id, CASE WHEN 1705000000000000000 + id * 20000000000000 <= safe_ts THEN 'ok' WHEN id % 2 = 0 OR id % 3 <> 0 THEN 'TimeOutOfRange' ELSE 'bump' END AS admission FROM safe""",
    "kv_action_errors": f"""WITH {_ACTS} SELECT txn, CASE code WHEN 'KeyNotFound' THEN 'NotFound' WHEN 'KeyAlreadyExists' THEN 'AlreadyExists' END AS error_code, CASE WHEN code = 'Success' THEN value END AS value,
        CASE code WHEN 'KeyAlreadyExists' THEN 'AlreadyExists' END AS read_error FROM done""",
    "kv_range_read_corrupt": f"WITH {_LIVE} SELECT key, commit_ts, value FROM live WHERE key >= 10 AND key < 10000000 AND value >= 20 ORDER BY key LIMIT 1000",
    "export_stream": f"WITH {_LOG}, t AS (SELECT count(*) AS c FROM log) SELECT k AS chunk, least(1000, c - k * 1000) AS n, c - k * 1000 < 1000 AS completed FROM (SELECT c, unnest(range(0, c // 1000 + 1)) AS k FROM t)",
    "export_stream_full": f"WITH {_LOG}, t AS (SELECT count(*) AS c FROM log) SELECT k AS chunk, least(500, c - k * 500) AS n, c - k * 500 < 500 AS completed FROM (SELECT c, unnest(range(0, c // 500 + 1)) AS k FROM t)",
    "kv_snapshot_read": f"WITH {_LIVE} SELECT key, commit_ts, value FROM live",
    "kv_latest": f"WITH {_LOG}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) AS rn FROM log) SELECT key, commit_ts, value FROM s WHERE rn = 1 AND NOT is_deleted",
    "kv_multiget": f"WITH {_LIVE} SELECT c_custkey AS key, value FROM customer LEFT JOIN live ON key = c_custkey",
    "kv_range_read_limit": f"WITH {_LIVE} SELECT key, commit_ts, value FROM live WHERE key >= 10 AND key < 60 ORDER BY key LIMIT 20",
    "kv_exists": f"WITH {_LIVE} SELECT c_custkey AS key, live.key IS NOT NULL AS found FROM customer LEFT JOIN live ON live.key = c_custkey",
    "kv_exists_in_range": f"WITH {_LIVE}, r AS (SELECT CAST(n_nationkey * 8 AS BIGINT) AS lo, CAST(n_nationkey * 8 + 3 AS BIGINT) AS hi FROM nation) SELECT lo, hi, EXISTS (SELECT 1 FROM live WHERE key >= lo AND key < hi) AS found FROM r",
    "kv_exact_version": f"WITH {_LOG}, asked AS (SELECT user_id AS key, epoch_us(ts) * 1000 + (event_id % 2) * 1000 AS commit_ts FROM events) SELECT key, commit_ts, value FROM asked LEFT JOIN log USING (key, commit_ts)",
    "kv_all_versions": f"WITH {_LOG} SELECT * FROM log WHERE (key > 20 OR key = 20 AND commit_ts <= 1705000000000000000) AND (key < 40 OR key = 40 AND commit_ts > 1705000000000000000)",
    "kv_asof_batch": f"""WITH {_LOG}, asked AS (SELECT row_number() OVER () AS id, o_orderkey % 200 AS key, 1704067200000000000 + o_custkey * 1000000000000 AS as_of FROM orders),
        s AS (SELECT id, a.key, as_of, commit_ts, value, is_deleted, row_number() OVER (PARTITION BY id ORDER BY commit_ts DESC) AS rn FROM asked a JOIN log ON log.key = a.key AND commit_ts <= as_of)
        SELECT key, as_of, commit_ts, value FROM s WHERE rn = 1 AND NOT is_deleted""",
    "kv_version_history": f"WITH {_LOG} SELECT key, commit_ts AS valid_from, coalesce(lead(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts), 0) AS valid_to, value, is_deleted FROM log",
    "kv_vacuum": f"""WITH {_LOG}, n AS (SELECT *, lead(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts) AS next_ts FROM log)
        SELECT key, commit_ts, value, is_deleted FROM n WHERE coalesce(next_ts > 1705000000000000000, true) AND NOT (is_deleted AND commit_ts <= 1705000000000000000)""",
    "kv_action_outcome": f"WITH {_ACTS} SELECT txn, key, commit_ts, kind, code FROM done",
    "kv_written_versions": f"WITH {_ACTS} SELECT key, commit_ts, CASE WHEN kind <> 'Delete' THEN value END AS value, kind = 'Delete' AS is_deleted FROM done WHERE code = 'Success' AND kind <> 'Read'",
    "kv_lock_conflicts": """WITH l AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_suppkey AS keyspace, l_partkey AS lo, l_partkey + 5 AS hi, l_linestatus = 'O' AS exclusive FROM lineitem)
        SELECT a.id AS requested_id, b.id AS held_id FROM l a JOIN l b ON a.keyspace = b.keyspace AND a.hi > b.lo AND a.lo < b.hi AND (a.exclusive OR b.exclusive) AND a.id < b.id""",
    "kv_safe_timestamp": f"WITH {_SAFE} SELECT id, safe_ts FROM safe",
    "txn_read_timestamp": f"WITH {_SAFE} SELECT max(safe_ts) AS read_ts FROM safe",
    "txn_decide": "SELECT l_orderkey AS txn, count(*) AS n_votes, bool_and(l_returnflag <> 'R') AS commit, CASE WHEN bool_and(l_returnflag <> 'R') THEN max(l_partkey) END AS commit_ts FROM lineitem GROUP BY 1",
    "txn_read_only": "SELECT user_id AS txn, count(*) AS n_actions, bool_and(event_type = 'view') AS read_only FROM events GROUP BY 1",
    "txn_status_counts": f"""WITH {_STATUS}, {_COMMANDS} SELECT count(*) AS tracked, count(*) FILTER (state NOT IN ('Committed', 'Timedout')) AS running,
        count(*) FILTER (state = 'Timedout') AS timedout, count(*) FILTER (NOT locks_released) AS locks_held, (SELECT count(*) FROM cmd WHERE refused) AS locks_failed,
        (SELECT count(*) FROM cmd WHERE seq = 2 AND NOT refused) AS validation_failed, (SELECT count(*) FROM events WHERE event_type = 'view') AS prepared_reads FROM status""",
    "txn_watch": f"""WITH {_STATUS} SELECT txn, state, locks_released, ts, CASE WHEN state = 'Prepared' AND 820454400000000000 - ts > 5000000000 THEN 'abort' WHEN state = 'Decided' AND 820454400000000000 - ts > 2000000000 THEN 'finish'
        ELSE 'wait' END AS todo FROM status WHERE state IN ('Prepared', 'Decided')""",
    "txn_collectable": f"WITH {_STATUS} SELECT txn, state, ts FROM status WHERE state IN ('Committed', 'Timedout') AND locks_released AND ts < 820454400000000000 - 10000000000",
    "hlc_split": "SELECT event_id, epoch_us(ts) * 1000 AS hlc, epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % 65536 AS physical, (epoch_us(ts) * 1000) % 65536 AS logical FROM events",
    "graph_vertex_keys": f"WITH {_VERTICES} SELECT type, value, {_VERTEX.format(t='type', v='value')} AS key_hex FROM vertices",
    "graph_vertex_decode": f"WITH {_VERTICES} SELECT CAST(type AS BIGINT) AS type, value FROM vertices",
    "graph_edge_keys": f"WITH {_EDGES} SELECT {_VERTEX.format(t='head_type', v='head_value')} || printf('%08X', type) || {_VERTEX.format(t='tail_type', v='tail_value')} AS key_hex, head_value AS head, CAST(type AS BIGINT) AS type, tail_value AS tail FROM edges",
    "graph_get_vertex": f"""WITH {_VLOG}, s AS (SELECT unnest([400000, 550000, 650000]) AS snapshot), t AS (SELECT snapshot, id, arg_max(is_deleted, commit_ts) AS gone, arg_max({{'p': payload}}, commit_ts).p AS payload
        FROM s, vlog WHERE commit_ts <= snapshot AND id IN (SELECT user_id FROM events) GROUP BY ALL) SELECT snapshot, id, payload FROM t WHERE NOT gone""",
    "graph_get_edge": f"""WITH {_ELOG}, s AS (SELECT unnest([400000, 550000]) AS snapshot), t AS (SELECT snapshot, id, arg_max(is_deleted, commit_ts) AS gone, arg_max({{'p': payload}}, commit_ts).p AS payload
        FROM s, elog WHERE commit_ts <= snapshot AND head IN (SELECT user_id FROM events) GROUP BY ALL) SELECT snapshot, id, payload FROM t WHERE NOT gone""",
    "graph_create_vertex": f"WITH {_VLOG}, {_VREQ} SELECT id, pos, CASE WHEN pos > 0 THEN 'LockFailed' WHEN id IN (SELECT id FROM live) THEN 'KeyAlreadyExists' ELSE 'Success' END AS code FROM req",
    "graph_update_vertex": f"""WITH {_VLOG}, {_VREQ} SELECT {_VERTEX.format(t='1', v='CAST(id AS VARCHAR)')} AS key_hex, CAST(550000 AS BIGINT) AS commit_ts, 'new ' || id AS payload, false AS is_deleted FROM req WHERE pos = 0 AND id IN (SELECT id FROM live)""",
    "graph_delete_vertex": f"""WITH {_VLOG}, {_ELOG}, {_VREQ}, left_ AS (SELECT head FROM (SELECT head, id, arg_max(is_deleted, commit_ts) AS gone FROM elog WHERE commit_ts < 550000 GROUP BY ALL) WHERE NOT gone)
        SELECT id, pos, CASE WHEN pos > 0 THEN 'LockFailed' WHEN id NOT IN (SELECT id FROM live) THEN 'KeyNotFound' WHEN id IN (SELECT head FROM left_) THEN 'LockCheckFailed' ELSE 'Success' END AS code FROM req""",
    "graph_create_edge": f"WITH {_ELOG}, {_EREQ} SELECT req.id, CASE WHEN live.id IS NOT NULL THEN 'KeyAlreadyExists' ELSE 'Success' END AS code FROM req LEFT JOIN live ON live.head = req.head AND live.id = req.id",
    "graph_update_edge": f"WITH {_ELOG}, {_EREQ} SELECT req.id, CASE WHEN live.id IS NULL THEN 'KeyNotFound' ELSE 'Success' END AS code FROM req LEFT JOIN live ON live.head = req.head AND live.id = req.id",
    "graph_delete_edge": f"""WITH {_ELOG}, {_EREQ} SELECT {_VERTEX.format(t='1', v='CAST(head AS VARCHAR)')} || '00000001' || {_VERTEX.format(t='4', v='CAST(id AS VARCHAR)')} AS key_hex, CAST(550000 AS BIGINT) AS commit_ts, true AS is_deleted
        FROM req JOIN live USING (head, id)""",
    "graph_undirected": f"WITH {_EDGES} SELECT * FROM edges WHERE head_type = 1 UNION SELECT tail_type, tail_value, type, head_type, head_value FROM edges WHERE head_type = 1",
    "graph_value_errors": "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'unknown type' WHEN event_id % 3 = 0 THEN 'no payload' END AS error FROM events",
    "graph_out_edges": f"WITH {_EDGES} SELECT * FROM edges WHERE head_type = 1 AND head_value IN (SELECT CAST(user_id AS VARCHAR) FROM events)",
    "graph_degrees": f"WITH {_EDGES} SELECT {_VERTEX.format(t='head_type', v='head_value')} AS head_hex, type, count(*) AS n_edges FROM edges GROUP BY ALL",
    "graph_delete_precheck": "SELECT 4 AS type, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "placement_deal": "SELECT CAST(floor(slot / 3) AS BIGINT) AS pid, slot % 3 AS replica, (slot + 1) % 7 AS server FROM (SELECT unnest(range(300)) AS slot)",
    "placement_imbalance": f"""WITH {_REPLICAS}, c AS (SELECT s AS server, count(r.replica) AS n FROM (SELECT unnest(range(10)) AS s) LEFT JOIN replicas r ON r.server = s AND r.state <> 'Leaving' GROUP BY 1)
        SELECT max(n) - min(n) AS imbalance FROM c""",
    "placement_violations": f"""WITH {_REPLICAS} SELECT DISTINCT pid, 'duplicate server' AS problem FROM (SELECT pid, server FROM replicas GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT p, 'not served' FROM (SELECT unnest(range(60)) AS p) WHERE p NOT IN (SELECT pid FROM replicas WHERE state IN ('Voter', 'NonVoter'))""",
    "placement_changes": f"""WITH {_REPLICAS}, o AS (SELECT * FROM replicas WHERE replica % 3 <> 1),
        n AS (SELECT * REPLACE (CASE WHEN replica % 4 = 0 THEN server + 1 ELSE server END AS server) FROM replicas WHERE replica % 3 <> 0)
        SELECT coalesce(o.pid, n.pid) AS pid, coalesce(o.replica, n.replica) AS replica, CASE WHEN o.pid IS NULL THEN 'Add' WHEN n.pid IS NULL THEN 'Remove' ELSE 'Update' END AS command,
        coalesce(n.server, o.server) AS server FROM o FULL JOIN n ON o.pid = n.pid AND o.replica = n.replica WHERE o.pid IS NULL OR n.pid IS NULL OR o.server <> n.server OR o.state <> n.state""",
    "placement_settle": f"WITH {_PLACED} SELECT pid, server, CASE WHEN state = 'Joining' AND ready THEN 'Voter' ELSE state END AS state FROM placed WHERE NOT (state = 'Leaving' AND ready)",
    "placement_addable": f"WITH {_PLACED} SELECT pid, server FROM pairs WHERE s_joining < 4 AND p_joining < 1 AND (SELECT count(*) FROM placed WHERE state = 'Joining') < 1000000",
    "placement_missing": f"""WITH {_PLACED}, r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s_total, s_joining, server) AS place FROM pairs WHERE p_joining < 2)
        SELECT pid, server FROM r WHERE place <= least(3 - p_total, 2 - p_joining)""",
    "placement_extra": f"""WITH {_PLACED}, r AS (SELECT x.*, row_number() OVER (PARTITION BY pid ORDER BY l.total DESC, created, server) AS place, count(*) OVER (PARTITION BY pid) - 2 AS over_ FROM placed x JOIN sload l USING (server)
        WHERE state IN ('Voter', 'NonVoter')) SELECT pid, server FROM r WHERE place <= over_""",
    "placement_command_errors": f"""WITH {_PLACED}, c AS (SELECT ['Add', 'Update', 'Remove'][(s_suppkey + i) % 3 + 1] AS command, s_suppkey + CASE WHEN i = 5 THEN 1000 ELSE 0 END AS pid, (s_suppkey * 7 + i * 3) % 15 AS server,
          ['Voter', 'NonVoter', 'Leaving', 'Joining'][(s_suppkey + i) % 4 + 1] AS state FROM (SELECT s_suppkey, unnest(range(7)) AS i FROM supplier))
        SELECT command, c.pid, c.server, c.state, CASE
          WHEN command = 'Add' THEN CASE WHEN c.pid > 999 OR c.server > 13 THEN 'invalid Add' WHEN p.state IS NOT NULL THEN 'same server' END
          WHEN command = 'Update' THEN CASE WHEN c.pid > 999 OR p.state IS NULL THEN 'invalid Update'
            WHEN NOT (c.state = 'Voter' AND p.state IN ('Joining', 'NonVoter') OR c.state = 'NonVoter' AND p.state IN ('Joining', 'Voter') OR c.state = 'Leaving') THEN 'invalid transition'
            WHEN serving = 1 AND p.state IN ('Voter', 'NonVoter') AND c.state NOT IN ('Voter', 'NonVoter') THEN 'last serving replica' END
          ELSE CASE WHEN c.pid > 999 OR p.state IS NULL THEN 'invalid Remove' WHEN p.state <> 'Leaving' THEN 'not leaving' END END AS error
        FROM c LEFT JOIN placed p ON p.pid = c.pid AND p.server = c.server LEFT JOIN pload l ON l.pid = c.pid""",
    "placement_transitions": """WITH s AS (SELECT unnest(['Stopped', 'Joining', 'Voter', 'NonVoter', 'Leaving']) AS state)
        SELECT b.state AS before, a.state AS after, CASE a.state WHEN 'Joining' THEN b.state = 'Stopped' WHEN 'Voter' THEN b.state IN ('Joining', 'NonVoter') WHEN 'NonVoter' THEN b.state IN ('Joining', 'Voter') WHEN 'Leaving' THEN b.state <> 'Stopped' ELSE false END AS valid,
          CASE WHEN b.state = a.state THEN NULL WHEN a.state = 'Stopped' THEN 'stopped' WHEN b.state = 'Leaving' THEN NULL WHEN a.state = 'Leaving' THEN 'leaving' WHEN a.state = 'Joining' THEN CASE WHEN b.state = 'Stopped' THEN 'joining' END ELSE 'serving' END AS becomes
        FROM s a CROSS JOIN s b""",
    "placement_availability": "SELECT avg(CAST(event_type <> 'error' AS INTEGER)) >= 0.8 AS ready, avg(CAST(event_type = 'view' AS INTEGER)) >= 0.2 AS failing FROM events",
    "admin_cluster": "SELECT unnest(['servers', 'last_id', 'name']) AS property, unnest([CAST(count(*) AS VARCHAR), CAST(max(s_suppkey) AS VARCHAR), 'main']) AS value FROM supplier",
    "admin_replica_status": "SELECT o_custkey % 50 AS pid, o_orderkey % 9 AS name, max(o_orderkey * 10) AS ts, arg_max(o_custkey, o_orderkey) AS applied FROM orders GROUP BY 1, 2",
    "admin_register": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS token, epoch_us(ts) * 1000 AS ts FROM events), f AS (SELECT token, min(ts) AS since FROM r GROUP BY 1),
        n AS (SELECT *, row_number() OVER (ORDER BY since, token) + 5 AS id FROM f) SELECT token, ts, id, 'data_' || id AS name, ts - since > 172800000000000 AS expired FROM r JOIN n USING (token)""",
    "admin_bootstrap": "SELECT 'new' AS name, unnest(range(7))::INTEGER AS pid UNION ALL SELECT 'old', unnest(range((SELECT count(*) FROM supplier)))::INTEGER",
    "admin_snapshot": f"WITH {_PLACED} SELECT * FROM placed",
    "admin_clock_skew": "WITH r AS (SELECT abs(event_id * 1001 + (event_id * 1001 - user_id * 13)) // 2 AS off FROM events) SELECT max(off) - min(off) AS skew FROM r",
    "rules_violations": """WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS words, * FROM part), e AS (SELECT p_partkey, list_filter([CASE WHEN p_size < 5 THEN 'size: less than 5' END, CASE WHEN p_size > 45 THEN 'size: more than 45' END,
          CASE WHEN p_name IS NULL OR p_name = '' THEN 'name: required' END, CASE WHEN length(p_name) < 8 THEN 'name: too short' WHEN length(p_name) > 9 THEN 'name: too long' END, CASE WHEN p_retailprice - 1000 <= 0 THEN 'price: not positive' END,
          CASE WHEN NOT p_partkey * 50 BETWEEN 1 AND 65535 THEN 'port: not a port' END, CASE WHEN len(words) < 1 THEN 'words: too few items' WHEN len(words) > 1 THEN 'words: too many items' END,
          CASE WHEN len(list_filter(words, lambda w: length(w) < 3 OR length(w) > 6)) > 0 THEN 'words: item of wrong length' END,
          CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') THEN 'brand: unknown value' END], lambda x: x IS NOT NULL) AS errors FROM p)
        SELECT p_partkey, array_to_string(errors, ';') AS errors FROM e WHERE len(errors) > 0""",
    "export_chunks": f"""WITH {_LOG}, n AS (SELECT key, row_number() OVER (ORDER BY key, commit_ts DESC) - 1 AS k FROM log)
        SELECT CAST(floor(k / 1000) AS BIGINT) AS chunk, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM n GROUP BY 1""",
    "export_resume": f"WITH {_LOG} SELECT key, commit_ts, value FROM log WHERE key > 75 OR key = 75 AND commit_ts <= 1705000000000000000",
    "admin_partitions": f"""WITH {_REPLICAS} SELECT pid, count(*) AS total, count(*) FILTER (state IN ('Voter', 'NonVoter')) AS serving, count(*) FILTER (state = 'Joining') AS joining,
        count(*) FILTER (state = 'Leaving') AS leaving, arg_max(leader, term) AS leader, max(term) AS term, max(applied) AS applied, max(committed) AS committed FROM replicas GROUP BY 1""",
    "admin_replicas": f"""WITH {_REPLICAS}, t AS (SELECT pid, arg_max(leader, term) AS top, max(committed) AS c FROM replicas GROUP BY 1)
        SELECT pid, name, state, name = top AS is_leader, c - applied AS lag FROM replicas JOIN t USING (pid)""",
    "admin_servers": "SELECT 'data' AS type, s_suppkey AS id, CAST(s_nationkey AS BIGINT) * 1000000000 AS last_seen, 20000000000 - CAST(s_nationkey AS BIGINT) * 1000000000 > 10000000000 AS stale FROM supplier",
    "admin_routing": f"WITH {_REPLICAS} SELECT pid, string_agg(CAST(server AS VARCHAR), ',' ORDER BY server) AS servers FROM replicas WHERE state IN ('Voter', 'NonVoter') GROUP BY 1",
    "history_stale_reads": f"""WITH {_OPS}, e AS (SELECT *, last_value(CASE WHEN op = 'w' THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY commit_ts, op = 'r', txn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected FROM ops)
        SELECT txn, key, value, expected FROM e WHERE op = 'r' AND value IS DISTINCT FROM expected""",
    "history_dependencies": f"WITH {_EDGES_OF} SELECT src, dst, kind FROM deps",
    "history_realtime": f"""WITH {_EDGES_OF} SELECT src, dst, kind, CASE WHEN kind = 'rw' THEN 'G2-realtime' ELSE 'G1c-realtime' END AS class FROM deps JOIN ops a ON a.txn = src JOIN ops b ON b.txn = dst
        WHERE b.commit_ts + b.txn % 5 * 3600000000000 < a.commit_ts""",
    "history_aborted_reads": f"WITH {_OPS} SELECT txn, key, value FROM ops WHERE op = 'r' AND value % 5 = 0",
    "history_outcomes": "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'info' WHEN event_type = 'click' THEN 'fail' ELSE 'ok' END AS outcome FROM events",
    "history_cycles": "WITH w AS (SELECT count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING count(*) > 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM w",
    "etags": "SELECT n_regionkey, translate(rtrim(base64(unhex(sha256(string_agg(n_name, '' ORDER BY n_name)))), '='), '+/', '-_') AS etag FROM nation GROUP BY 1",
}
