"""SQL that gives the rows of plans.queries, written the plain way: step by step, with EXISTS where we join."""

from __future__ import annotations

from ..operators.restore import PARENT_DIRTY, PARENT_MISSING
from ..schemas import RECORD_COLUMNS
from .derive import FILTERS, MEETING, PROFILE, SESSION, with_tables

_SEEN = "EXISTS (SELECT 1 FROM rmc WHERE rmc.id = b.model_uuid AND rmc.instance_id = b.last_saved_instance AND rmc.counter >= b.last_saved_counter)"
_PASSED = "EXISTS (SELECT 1 FROM rmcb WHERE rmcb.model_uuid = s.id AND rmcb.instance_id = s.last_saved_instance AND rmcb.counter >= s.last_saved_counter)"
#: class of each buffered record
CLS = f"cls AS (SELECT b.model_uuid, CASE WHEN s.id IS NULL THEN 'NEW' WHEN {_SEEN} THEN 'REVERSE_FF' WHEN {_PASSED} THEN 'FAST_FORWARD' ELSE 'CONFLICT' END AS class FROM buffer b LEFT JOIN store s ON s.id = b.model_uuid)"


def _wire(table: str, name: str, pairs: str | None = None) -> str:
    """Wire entries of a vector table, redundant ones removed; name_parts has all partitions by side."""
    reach = f"AND EXISTS (SELECT 1 FROM {pairs} q WHERE q.instance_id = d.instance_id AND starts_with(q.partition, d.partition))" if pairs else ""
    return f"""{name}_raw AS (SELECT 'sub' AS side, d.* FROM {table} d WHERE EXISTS (SELECT 1 FROM filters WHERE starts_with(d.partition, f)) {reach}
  UNION ALL SELECT 'super', d.* FROM {table} d WHERE EXISTS (SELECT 1 FROM filters WHERE starts_with(f, d.partition) AND f <> d.partition) {reach}),
{name}_left AS (SELECT * FROM {name}_raw a WHERE NOT EXISTS (SELECT 1 FROM {name}_raw b WHERE b.instance_id = a.instance_id AND starts_with(a.partition, b.partition) AND a.partition <> b.partition AND b.counter >= a.counter)),
{name} AS (SELECT * FROM {name}_left UNION ALL SELECT DISTINCT side, partition, NULL, NULL::INT FROM {name}_raw r WHERE NOT EXISTS (SELECT 1 FROM {name}_left l WHERE l.side = r.side AND l.partition = r.partition))"""


def _expand(wire: str, name: str) -> str:
    return f"""{name}_parts AS (SELECT partition FROM {wire} WHERE side = 'sub' UNION SELECT f FROM filters),
{name}_tops AS (SELECT partition FROM {name}_parts a WHERE NOT EXISTS (SELECT 1 FROM {name}_parts b WHERE starts_with(a.partition, b.partition) AND a.partition <> b.partition)),
{name} AS (SELECT partition, instance_id, max(counter)::INT AS counter FROM (SELECT partition, instance_id, counter FROM {wire} WHERE side = 'sub' AND instance_id IS NOT NULL
  UNION ALL SELECT t.partition, w.instance_id, w.counter FROM {name}_tops t JOIN {wire} w ON w.side = 'super' AND w.instance_id IS NOT NULL AND starts_with(t.partition, w.partition)) GROUP BY ALL)"""


def _flat(table: str, name: str, producer: bool) -> str:
    each = f"{name}_each AS (SELECT f, instance_id, max(counter) AS m FROM filters JOIN {table} ON starts_with(f, partition) GROUP BY ALL)"
    if producer:
        return f"{each}, {name} AS (SELECT instance_id, max(m)::INT AS counter FROM {name}_each GROUP BY 1)"
    return f"{each}, {name} AS (SELECT instance_id, min(m)::INT AS counter FROM {name}_each GROUP BY 1 HAVING count(DISTINCT f) = {len(FILTERS)})"


_BOTH = ", ".join([_wire("dmc", "ws"), _wire("peer", "wh"), _expand("ws", "sent"), _expand("wh", "had")])
_FLATS = ", ".join([_flat("dmc", "fs", True), _flat("peer", "fh", False)])
_DIFF = """diff AS (SELECT a.partition, a.instance_id, coalesce(max(b.counter), 0)::INT AS counter FROM sent a LEFT JOIN had b ON b.instance_id = a.instance_id AND starts_with(a.partition, b.partition)
  GROUP BY a.partition, a.instance_id, a.counter HAVING coalesce(max(b.counter), 0) < a.counter)"""
_FDIFF = "fdiff AS (SELECT a.instance_id, coalesce(b.counter, 0)::INT AS counter FROM fs a LEFT JOIN fh b USING (instance_id) WHERE coalesce(b.counter, 0) < a.counter)"
_PAIRS_S = "ps AS (SELECT DISTINCT partition, last_saved_instance AS instance_id FROM store)"
_PAIRS_R = "pr AS (SELECT DISTINCT partition, instance_id FROM rmc JOIN store USING (id))"
_RECORD = ", ".join(RECORD_COLUMNS)
_REFS = "refs AS (SELECT l_orderkey || '-' || l_linenumber AS from_id, id AS to_id FROM lineitem JOIN base ON l_orderkey = k)"
_DELETES = f"gone AS (SELECT id FROM base WHERE k % 10 = 1 AND k % 4 <> 1 AND '{PROFILE}' = '{PROFILE}')"
_TREE = "tree AS (SELECT c_custkey AS id, nullif(c_custkey // 2, 0) AS parent_id FROM customer)"
_SYNCS = """syncs AS (SELECT c_custkey::VARCHAR AS id, c_custkey % 5 <> 0 AS active, TIMESTAMP '1997-12-31 12:00:00' + to_hours((c_custkey % 24)::INT) AS last_activity FROM customer),
transfers AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS sync_session_id, o_orderkey % 3 <> 0 AS active, TIMESTAMP '1997-12-31 12:00:00' + to_hours((o_orderkey % 24)::INT) AS last_activity, 'n' || o_custkey AS filter FROM orders)"""

_CONSONANTS, _VOWELS = "bdfghjklmnprstvz", "aiou"


def _quint(n: str) -> str:
    pick = lambda letters, shift, mask: f"substr('{letters}', (({n} >> {shift}) & {mask})::INT + 1, 1)"
    return " || ".join([pick(_CONSONANTS, 12, 15), pick(_VOWELS, 10, 3), pick(_CONSONANTS, 6, 15), pick(_VOWELS, 4, 3), pick(_CONSONANTS, 0, 15)])


def _t(body: str, *ctes: str) -> str:
    return with_tables(("+" + ", ".join(ctes) + "\n" if ctes else "") + body)


_MERGED = {
    "serialized": "CASE WHEN b.hard_deleted THEN '' ELSE s.serialized END",
    "deleted": "s.deleted OR b.deleted",
    "hard_deleted": "s.hard_deleted OR b.hard_deleted",
    "last_saved_instance": "'i3'",
    "last_saved_counter": "500",
    "conflicting_serialized_data": "CASE WHEN b.hard_deleted THEN '' ELSE b.serialized || chr(10) || s.conflicting_serialized_data END",
}
_CONFLICT_COLUMNS = ", ".join(f"{_MERGED.get(c, 's.' + c)} AS {c}" for c in RECORD_COLUMNS)
_S, _B = (", ".join(f"{x}.{c}" for c in RECORD_COLUMNS) for x in "sb")

_ORDERED = f"""SELECT s.id, {_S}, s.dirty_bit, s.deserialization_error, s.last_transfer_session_id FROM store s LEFT JOIN cls ON s.id = model_uuid WHERE class IS NULL OR class = 'REVERSE_FF'
UNION ALL SELECT b.model_uuid, {_B}, true, '', '{SESSION}' FROM buffer b JOIN cls USING (model_uuid) WHERE class IN ('NEW', 'FAST_FORWARD')
UNION ALL SELECT s.id, {_CONFLICT_COLUMNS}, true, '', '{SESSION}' FROM store s JOIN buffer b ON s.id = b.model_uuid JOIN cls ON cls.model_uuid = s.id WHERE class = 'CONFLICT'"""
_ORDERED_RMC = """SELECT * FROM rmc WHERE NOT EXISTS (SELECT 1 FROM cls WHERE model_uuid = id AND class <> 'REVERSE_FF')
UNION ALL SELECT coalesce(a.id, b.model_uuid), coalesce(a.instance_id, b.instance_id), coalesce(b.counter, a.counter) FROM (SELECT * FROM rmc WHERE id IN (SELECT model_uuid FROM cls WHERE class IN ('NEW', 'FAST_FORWARD'))) a
  FULL JOIN (SELECT * FROM rmcb WHERE model_uuid IN (SELECT model_uuid FROM cls WHERE class IN ('NEW', 'FAST_FORWARD'))) b ON a.id = b.model_uuid AND a.instance_id = b.instance_id
UNION ALL SELECT id, instance_id, max(counter)::INT FROM (SELECT * FROM rmc UNION ALL SELECT model_uuid, instance_id, counter FROM rmcb UNION ALL SELECT model_uuid, 'i3', 500 FROM cls) WHERE id IN (SELECT model_uuid FROM cls WHERE class = 'CONFLICT') GROUP BY ALL"""


def _meeting() -> str:
    """Merging the sessions one after another: s0 and v0 are store and vectors, s1 and v1 those after the first session."""
    out = ["s0 AS (SELECT * EXCLUDE (k) FROM store)", "v0 AS (SELECT * FROM rmc)"]
    for n, name in enumerate(MEETING):
        instance, counter = f"'i' || ((k + {n}) % 7)", f"((k * {3 + n}) % 101 + 1)::INT"
        record = ", ".join({"serialized": f"""'{{"k":' || k || ',"v":{n + 2}}}' AS serialized""", "last_saved_instance": f"{instance} AS last_saved_instance", "last_saved_counter": f"{counter} AS last_saved_counter"}.get(c, c) for c in RECORD_COLUMNS)
        conflict = ", ".join({**_MERGED, "last_saved_counter": str(500 + n)}.get(c, "s." + c) + f" AS {c}" for c in RECORD_COLUMNS)
        of = lambda kinds: f"(SELECT model_uuid FROM c{n} WHERE class IN ({kinds}))"  # noqa: B023, E731
        out += [
            f"b{n} AS (SELECT model_uuid, {record} FROM buffer WHERE k % 5 <> {n})",
            f"g{n} AS (SELECT model_uuid, instance_id, max(counter)::INT AS counter FROM (SELECT model_uuid, instance_id, counter FROM rmcb WHERE model_uuid IN (SELECT model_uuid FROM b{n}) UNION ALL SELECT model_uuid, last_saved_instance, last_saved_counter FROM b{n}) GROUP BY ALL)",
            f"""c{n} AS (SELECT b.model_uuid, CASE WHEN s.id IS NULL THEN 'NEW' WHEN EXISTS (SELECT 1 FROM v{n} v WHERE v.id = b.model_uuid AND v.instance_id = b.last_saved_instance AND v.counter >= b.last_saved_counter) THEN 'REVERSE_FF'
  WHEN EXISTS (SELECT 1 FROM g{n} g WHERE g.model_uuid = s.id AND g.instance_id = s.last_saved_instance AND g.counter >= s.last_saved_counter) THEN 'FAST_FORWARD' ELSE 'CONFLICT' END AS class FROM b{n} b LEFT JOIN s{n} s ON s.id = b.model_uuid)""",
            f"""s{n + 1} AS (SELECT s.id, {_S}, s.dirty_bit, s.deserialization_error, s.last_transfer_session_id FROM s{n} s WHERE id NOT IN {of("'NEW', 'FAST_FORWARD', 'CONFLICT'")}
  UNION ALL SELECT b.model_uuid, {_B}, true, '', '{name}' FROM b{n} b WHERE model_uuid IN {of("'NEW', 'FAST_FORWARD'")}
  UNION ALL SELECT s.id, {conflict}, true, '', '{name}' FROM s{n} s JOIN b{n} b ON s.id = b.model_uuid WHERE s.id IN {of("'CONFLICT'")})""",
            f"""v{n + 1} AS (SELECT v.* FROM v{n} v WHERE NOT EXISTS (SELECT 1 FROM g{n} g WHERE g.model_uuid = v.id AND g.instance_id = v.instance_id AND v.id IN {of("'NEW', 'FAST_FORWARD'")}) AND v.id NOT IN {of("'CONFLICT'")}
  UNION ALL SELECT * FROM g{n} WHERE model_uuid IN {of("'NEW', 'FAST_FORWARD'")}
  UNION ALL SELECT id, instance_id, max(counter)::INT FROM (SELECT * FROM v{n} UNION ALL SELECT * FROM g{n} UNION ALL SELECT model_uuid, 'i3', {500 + n} FROM c{n}) WHERE id IN {of("'CONFLICT'")} GROUP BY ALL)""",
        ]
    return ",\n".join(out)


_LAST = f"s{len(MEETING)}"
_ROW = ", ".join(c for c in ["id", *RECORD_COLUMNS, "deserialization_error", "last_transfer_session_id"] if c != "profile")
_DMC_PARTS = "SELECT coalesce(p.partition, w.partition) AS partition, coalesce(p.instance_id, w.instance_id) AS instance_id, greatest(p.counter, w.counter) AS counter FROM peer p FULL JOIN (SELECT * FROM ws WHERE side = 'sub' AND instance_id IS NOT NULL) w ON p.partition = w.partition AND p.instance_id = w.instance_id"
#: Orders that a capture under the filters takes, and those that it leaves dirty.
_CHANGED = "changed AS (SELECT * FROM base WHERE k % 2 = 0 AND EXISTS (SELECT 1 FROM filters WHERE starts_with(partition, f)))"
_SAVED = "saved AS (SELECT id FROM changed UNION SELECT id FROM store WHERE k % 10 = 1 AND k % 4 <> 1)"
#: Customers and orders of a whole restore: what is wrong with each, and what its reference points at.
_RESTORED = """u AS (SELECT c_custkey AS c, 'u' || c_custkey AS id, c_custkey % 4 <> 0 AS dirty, c_custkey % 13 = 0 AS deleted, c_custkey % 39 = 0 AS hard, CASE WHEN c_custkey % 10 = 0 THEN 'old' ELSE '' END AS old,
  CASE WHEN c_custkey % 4 = 0 OR c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN '{"name": "This field cannot be blank."}' WHEN c_custkey % 25 = 0 THEN '{"name": "Ensure this value has at most 12 characters."}' END AS error FROM customer),
o AS (SELECT 'o' || o_orderkey AS id, o_orderkey AS k, o_custkey AS c, o_orderkey % 3 <> 0 AS dirty, o_orderkey % 23 = 0 AS deleted, CASE WHEN o_orderkey % 10 = 0 THEN 'old' ELSE '' END AS old, CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE 'u' END || o_custkey AS ref FROM orders),
b AS (SELECT o.*, CASE WHEN NOT o.dirty OR o.deleted THEN NULL WHEN k % 31 = 0 THEN '{"serialized": "Payload is not JSON.", "user_id": "This field cannot be null."}' WHEN k % 19 = 0 THEN '{"user_id": "This field cannot be null."}'
  WHEN k % 17 = 0 OR u.error IS NOT NULL THEN '{"user_id": "no user has the id ' || ref || '"}' END AS error, u.deleted AND o.dirty AND NOT o.deleted AS points_at_deleted, u.hard FROM o JOIN u USING (c))"""
_APPS = """SELECT 'user' AS model, id, CASE WHEN dirty THEN 'c' || c ELSE 'before' END AS value, false AS _dirty FROM u WHERE NOT deleted AND error IS NULL
UNION ALL SELECT 'booking', id, ref, false FROM b WHERE dirty AND NOT deleted AND error IS NULL AND NOT points_at_deleted
UNION ALL SELECT 'booking', b.id, 'u' || b.c, false FROM b JOIN u USING (c) WHERE NOT b.dirty AND NOT b.deleted AND NOT (u.dirty AND u.deleted)"""
_MARKS = """SELECT id, error IS NOT NULL AS dirty_bit, coalesce(error, old) AS deserialization_error, false AS to_delete, false AS to_erase FROM u
UNION ALL SELECT id, error IS NOT NULL, coalesce(error, old), error IS NULL AND points_at_deleted, error IS NULL AND points_at_deleted AND hard FROM b"""
_NODES = f"""WITH RECURSIVE n AS (SELECT c_custkey AS k, c_custkey // 2 AS p, CASE WHEN c_custkey % 29 = 0 THEN 'lost' || c_custkey WHEN c_custkey = 1 THEN '' ELSE 'f' || (c_custkey // 2) END AS up, c_custkey % 29 = 0 AS lost, c_custkey % 41 = 0 AS gone, c_custkey % 11 <> 0 AS dirty,
  c_custkey * 7 % (SELECT count(*) FROM supplier) + 1 AS s FROM customer),
m AS (SELECT *, CASE WHEN gone THEN NULL WHEN k % 37 = 0 THEN '{{"serialized": "Payload is not JSON."}}' WHEN s % 7 = 0 OR (s % 3 <> 0 AND s % 5 = 0) THEN '{{"owner_id": "no user has the id u' || s || '"}}' END AS own, '{{"parent_id": "no node has the id ' || up || '"}}' AS orphan FROM n),
r AS (SELECT k, gone, CASE WHEN gone THEN NULL WHEN own IS NOT NULL THEN own WHEN k <> 1 AND p % 41 = 0 THEN orphan END AS error FROM m WHERE dirty AND (k = 1 OR (NOT lost AND p % 11 = 0))
  UNION ALL SELECT m.k, m.gone, CASE WHEN m.gone THEN NULL WHEN own IS NOT NULL THEN own WHEN r.gone THEN orphan END FROM r JOIN m ON m.p = r.k AND m.dirty AND NOT m.lost AND m.k <> 1 WHERE r.error IS NULL)
SELECT 'f' || m.k AS id, m.dirty AND (r.k IS NULL OR r.error IS NOT NULL) AS dirty_bit, CASE WHEN NOT m.dirty THEN '' WHEN r.k IS NOT NULL THEN coalesce(r.error, '') WHEN m.lost THEN '{PARENT_MISSING}' ELSE '{PARENT_DIRTY}' END AS deserialization_error,
  CASE WHEN m.gone THEN NULL WHEN NOT m.dirty THEN '' WHEN r.k IS NOT NULL AND r.error IS NULL THEN 'u' || s END AS owner FROM m LEFT JOIN r USING (k)"""

ORACLES: dict[str, str] = {
    "prefix_filter": _t("SELECT id, partition FROM store WHERE EXISTS (SELECT 1 FROM filters WHERE starts_with(partition, f))"),
    "reverse_prefix": _t("SELECT * FROM dmc WHERE starts_with('n1:c5:orders', partition)"),
    "version_bound": _t("SELECT id, last_saved_instance, last_saved_counter FROM store WHERE last_saved_counter > 10 * substr(last_saved_instance, 2)::INT"),
    "filter_subset": """WITH n AS (SELECT n_nationkey, regexp_split_to_array(trim(n_name || ' n' || n_nationkey), '\\s+') AS fs FROM nation)
SELECT n_nationkey, len(list_filter(fs, lambda x: NOT (starts_with(x, 'n1') OR starts_with(x, 'A') OR starts_with(x, 'I')))) = 0 AS inside, len(list_filter(fs, lambda x: starts_with('n12:x', x))) > 0 AS holds,
  list_sort(list_distinct(fs)) = ['A', 'I', 'n1'] AS same FROM n""",
    "scope_permission": """WITH c AS (SELECT c_custkey, 'n' || c_nationkey AS o, 'n' || c_nationkey || ':c' || c_custkey AS w FROM customer)
SELECT c_custkey, (CASE WHEN c_custkey % 4 = 0 THEN starts_with(w, 'n2') ELSE true END) AND (starts_with(w, 'n1') OR starts_with(w, 'n2')) AS push,
  (CASE WHEN c_custkey % 3 = 0 THEN starts_with(w, 'n1') ELSE true END) AND (CASE WHEN c_custkey % 5 = 0 THEN starts_with(w, 'n7') OR starts_with(w, 'n1') ELSE true END) AS pull FROM c""",
    "namespaced_id": """WITH o AS (SELECT o_orderkey, '${id}:c' || o_custkey AS place, substr(sha256('${id}:c' || o_custkey || '::' || o_orderkey || '::order'), 1, 32) AS id FROM orders)
SELECT o_orderkey, id, replace(place, '${id}', id) AS partition FROM o""",
    "composed_id": "SELECT o_orderkey, substr(sha256(concat_ws(':', nullif(o_orderstatus, ''), CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE nullif(o_orderpriority, '') END, o_custkey::VARCHAR)), 1, 32) AS id FROM orders",
    "uuid_normal": _t("SELECT k, CASE WHEN k % 5 <> 0 THEN id END AS id FROM base"),
    "record_validation": _t(f"""SELECT model_uuid, 'other' AS profile, CASE WHEN k % 43 = 0 OR k % 23 = 0 THEN 'record of another transfer' WHEN k % 19 = 0 THEN 'outside of the filter: no partition'
  WHEN NOT EXISTS (SELECT 1 FROM filters WHERE starts_with(partition, f)) THEN 'outside of the filter: ' || partition WHEN k % 9 = 0 OR k % 29 = 0 THEN 'id is not that of its fields'
  WHEN k % 31 = 0 THEN 'vector entry of another record' WHEN k % 37 = 0 OR k % 41 = 0 THEN 'vector entry of another transfer, or no list of entries' END AS problem FROM buffer WHERE transfer_session_id = '{SESSION}'"""),
    "json_serialize": """SELECT o_orderkey AS k, '{"k":' || o_orderkey || ',"status":"' || o_orderstatus || '","cust":' || CASE WHEN o_custkey % 3 > 0 THEN '"' || o_custkey || '"' ELSE 'null' END || '}' AS serialized FROM orders""",
    "json_deserialize": _t("SELECT id, json_extract_string(serialized, '$.k')::BIGINT AS k, json_extract_string(serialized, '$.v')::INT AS v, 7 AS w FROM store"),
    "json_merge": _t("SELECT id, k, 3::BIGINT AS v, k AS w FROM store"),
    "char_ids": _t("SELECT id FROM store WHERE dirty_bit"),
    "lock_keys": _t("SELECT DISTINCT substr(partition, 1, 32) AS partition FROM store"),
    "nonce_check": "SELECT event_id, event_id % 2 <> 0 AND epoch(TIMESTAMP '2024-01-01 00:00:00') - epoch(ts) > 0 AND epoch(TIMESTAMP '2024-01-01 00:00:00') - epoch(ts) < 60 AS usable FROM events",
    "proquints": f"""WITH o AS (SELECT o_orderkey, o_orderkey * 1000003 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 4294967296 THEN {_quint("(n >> 32)")} || '-' ELSE '' END || CASE WHEN n >= 65536 THEN {_quint("(n >> 16)")} || '-' ELSE '' END || {_quint("n")} AS name, n AS number FROM o""",
    "system_hashes": """WITH o AS (SELECT o_orderkey, o_orderpriority, printf('%012x', o_orderkey * 7000000019) AS h FROM orders)
SELECT o_orderkey, substr(sha1(lower(o_orderpriority || '::b88281f3-302c-4def-bb87-043f681e4183')), 1, 20) AS hash, regexp_replace(h, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS mac,
  ('0x' || substr(h, 1, 2))::INT % 2 = 1 AS multicast, (('0x' || substr(h, 1, 2))::INT >> 1) % 2 = 1 AS local FROM o""",
    "dirty_upsert_split": _t("SELECT b.id, s.id IS NULL AS is_new FROM base b LEFT JOIN store s ON s.id = b.id"),
    "rmc_for_buffer": _t("SELECT transfer_session_id, model_uuid, instance_id, counter FROM rmc JOIN buffer ON rmc.id = model_uuid"),
    "reverse_ff": _t("SELECT model_uuid FROM cls WHERE class = 'REVERSE_FF'", CLS),
    "conflicts": _t("SELECT model_uuid FROM cls WHERE class = 'CONFLICT'", CLS),
    "fast_forward": _t("SELECT model_uuid FROM cls WHERE class = 'FAST_FORWARD'", CLS),
    "fk_missing": _t("SELECT from_id, to_id, 'no order has the id ' || to_id AS error FROM refs WHERE NOT EXISTS (SELECT 1 FROM store WHERE store.id = to_id)", _REFS),
    "fk_deleted": _t("SELECT from_id, to_id, hard_deleted AS hard FROM refs JOIN store ON store.id = to_id WHERE deleted OR hard_deleted", _REFS),
    "fsic_reduction_producer": _t("SELECT * FROM wide d WHERE EXISTS (SELECT 1 FROM ps q WHERE q.instance_id = d.instance_id AND starts_with(q.partition, d.partition))", _PAIRS_S),
    "fsic_reduction_receiver": _t("SELECT * FROM wide d WHERE EXISTS (SELECT 1 FROM pr q WHERE q.instance_id = d.instance_id AND starts_with(q.partition, d.partition))", _PAIRS_R),
    "prefix_pairs": _t("SELECT a.partition AS path, b.partition AS prefix FROM (SELECT DISTINCT partition FROM dmc) a JOIN (SELECT DISTINCT partition FROM dmc) b ON starts_with(a.partition, b.partition) AND a.partition <> b.partition"),
    "parent_closure": f"WITH RECURSIVE {_TREE}, r AS (SELECT id, 0 AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, depth + 1 FROM r JOIN tree t ON t.parent_id = r.id) SELECT id, min(depth)::INT AS depth FROM r GROUP BY id",
    "certificate_ancestors": f"WITH RECURSIVE {_TREE}, r AS (SELECT id, 0 AS depth FROM tree WHERE id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL) UNION ALL SELECT t.parent_id, depth + 1 FROM r JOIN tree t ON t.id = r.id WHERE t.parent_id IS NOT NULL) SELECT id, min(depth)::INT AS depth FROM r GROUP BY id",
    "fk_cascade": f"""WITH RECURSIVE {_TREE}, c AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 4 UNION SELECT t.id FROM c JOIN tree t ON t.parent_id = c.id)
SELECT 'nation' AS table_name, 4::BIGINT AS id UNION ALL SELECT 'customer', id FROM c UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey IN (SELECT id FROM c)""",
    "fsic_v1_producer": _t("SELECT * FROM fs", _flat("dmc", "fs", True)),
    "fsic_v1_receiver": _t("SELECT * FROM fr", _flat("dmc", "fr", False)),
    "fsic_v2_sub": _t("SELECT partition, instance_id, counter FROM w WHERE side = 'sub'", _PAIRS_S, _wire("dmc", "w", "ps")),
    "fsic_v2_super": _t("SELECT partition, instance_id, counter FROM w WHERE side = 'super'", _PAIRS_R, _wire("dmc", "w", "pr")),
    "fsic_redundant": _t("SELECT * FROM dmc a WHERE NOT EXISTS (SELECT 1 FROM dmc b WHERE b.instance_id = a.instance_id AND starts_with(a.partition, b.partition) AND a.partition <> b.partition AND b.counter >= a.counter)"),
    "fsic_expand": _t("SELECT * FROM sent", _wire("dmc", "ws"), _expand("ws", "sent")),
    "fsic_diff_v1": _t("SELECT * FROM fdiff", _FLATS, _FDIFF),
    "fsic_diff_v2": _t("SELECT * FROM diff", _BOTH, _DIFF),
    "dmc_update_v1": _t("SELECT partition, instance_id, max(counter)::INT AS counter FROM (SELECT * FROM peer UNION ALL SELECT f, a.instance_id, a.counter FROM fs a LEFT JOIN fh b USING (instance_id), filters WHERE coalesce(b.counter, 0) < a.counter) GROUP BY ALL", _FLATS),
    "dmc_update_v2": _t(_DMC_PARTS, _wire("dmc", "ws")),
    "queue_v1": _t(f"SELECT 't2' AS transfer_session_id, id AS model_uuid, {_RECORD} FROM store s WHERE EXISTS (SELECT 1 FROM filters WHERE starts_with(partition, f)) AND EXISTS (SELECT 1 FROM fdiff d WHERE d.instance_id = s.last_saved_instance AND s.last_saved_counter > d.counter)", _FLATS, _FDIFF),
    "queue_v2": _t(f"SELECT 't2' AS transfer_session_id, id AS model_uuid, {_RECORD} FROM store s WHERE EXISTS (SELECT 1 FROM diff d WHERE d.instance_id = s.last_saved_instance AND s.last_saved_counter > d.counter AND starts_with(s.partition, d.partition))", _BOTH, _DIFF),
    "queue_v2_vectors": _t("SELECT 't2' AS transfer_session_id, id AS model_uuid, instance_id, counter FROM rmc WHERE id IN (SELECT id FROM store s WHERE EXISTS (SELECT 1 FROM diff d WHERE d.instance_id = s.last_saved_instance AND s.last_saved_counter > d.counter AND starts_with(s.partition, d.partition)))", _BOTH, _DIFF),
    "queued_count": _t("SELECT transfer_session_id, count(*) AS records_total FROM buffer GROUP BY 1"),
    "dequeue_classify": _t("SELECT class, count(*) AS n FROM cls GROUP BY 1", CLS),
    "dequeue_store": _t(_ORDERED, CLS),
    "dequeue_rmc": _t(_ORDERED_RMC, CLS),
    "kept_summary": _t(f"""SELECT 'saved' AS kind, partition, last_saved_instance AS instance_id, count(*) AS records FROM ms GROUP BY ALL
UNION ALL SELECT 'seen', partition, instance_id, count(*) FROM mv JOIN ms USING (id) GROUP BY ALL""", CLS, f"ms AS ({_ORDERED})", f"mv AS ({_ORDERED_RMC})"),
    "soft_delete": _t("SELECT s.id, deleted OR g.id IS NOT NULL AS deleted, dirty_bit AND g.id IS NULL AS dirty_bit, CASE WHEN g.id IS NULL THEN last_saved_instance ELSE 'i3' END AS last_saved_instance, CASE WHEN g.id IS NULL THEN last_saved_counter ELSE 500 END AS last_saved_counter FROM store s LEFT JOIN gone g ON g.id = s.id", _DELETES),
    "hard_delete": _t("SELECT s.id, hard_deleted OR g.id IS NOT NULL AS hard_deleted, CASE WHEN g.id IS NULL THEN serialized ELSE '{}' END AS serialized, CASE WHEN g.id IS NULL THEN conflicting_serialized_data ELSE '' END AS conflicting_serialized_data FROM store s LEFT JOIN gone g ON g.id = s.id", _DELETES),
    "app_upsert": _t("SELECT id, 'old' AS v, k FROM base WHERE k % 3 <> 0 AND k % 4 <> 0 UNION ALL SELECT id, 'new', k * 2 FROM base WHERE k % 4 = 0"),
    "partial_update": _t("SELECT id, k, CASE WHEN k % 8 = 0 THEN NULL WHEN k % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM base"),
    "touched_vectors": _t("SELECT * FROM rmc WHERE NOT (instance_id = 'i3' AND id IN (SELECT id FROM store WHERE dirty_bit)) UNION ALL SELECT id, 'i3', 500 FROM store WHERE dirty_bit"),
    "touched_ids": _t("SELECT id FROM store WHERE last_transfer_session_id = 't0' AND model_name = 'order'"),
    "capture_rows": _t("""SELECT b.id, b.partition, b.k::VARCHAR AS source_id, b.k::VARCHAR AS k, CASE WHEN s.id IS NOT NULL THEN '1' END AS v, b.o_orderstatus AS status, false AS deleted, 'i3' AS last_saved_instance, 500 AS last_saved_counter,
  CASE WHEN s.dirty_bit THEN s.serialized || chr(10) || s.conflicting_serialized_data ELSE coalesce(s.conflicting_serialized_data, '') END AS conflicting_serialized_data, false AS dirty_bit, NULL::VARCHAR AS last_transfer_session_id
FROM base b LEFT JOIN store s ON s.id = b.id WHERE b.k % 2 = 0"""),
    "serialize_store": _t("""SELECT b.id, b.partition, b.k::VARCHAR AS source_id, b.k::VARCHAR AS k, CASE WHEN s.id IS NOT NULL THEN '1' END AS v, b.o_orderstatus AS status, false AS deleted, false AS hard_deleted, 'i3' AS last_saved_instance, 500 AS last_saved_counter,
  CASE WHEN s.dirty_bit THEN s.serialized || chr(10) || s.conflicting_serialized_data ELSE coalesce(s.conflicting_serialized_data, '') END AS conflicting_serialized_data, false AS dirty_bit, NULL::VARCHAR AS last_transfer_session_id FROM changed b LEFT JOIN store s ON s.id = b.id
UNION ALL SELECT id, partition, source_id, CASE WHEN k % 30 <> 1 THEN k::VARCHAR END, CASE WHEN k % 30 <> 1 THEN '1' END, NULL, deleted OR (k % 10 = 1 AND k % 4 <> 1), hard_deleted OR k % 30 = 1, CASE WHEN k % 10 = 1 AND k % 4 <> 1 THEN 'i3' ELSE last_saved_instance END,
  CASE WHEN k % 10 = 1 AND k % 4 <> 1 THEN 500 ELSE last_saved_counter END, CASE WHEN k % 30 = 1 THEN '' ELSE conflicting_serialized_data END, dirty_bit AND NOT (k % 10 = 1 AND k % 4 <> 1), last_transfer_session_id FROM store WHERE id NOT IN (SELECT id FROM changed)""", _CHANGED),
    "serialize_vectors": _t("""SELECT 'record' AS kind, id, instance_id, counter FROM rmc WHERE NOT (instance_id = 'i3' AND id IN (SELECT id FROM saved)) UNION ALL SELECT 'record', id, 'i3', 500 FROM saved
UNION ALL SELECT 'database', partition, instance_id, counter FROM dmc WHERE NOT (instance_id = 'i3' AND partition IN (SELECT f FROM filters)) UNION ALL SELECT 'database', f, 'i3', 500 FROM filters
UNION ALL SELECT 'dirty', id, NULL, NULL FROM base WHERE k % 2 = 0 AND id NOT IN (SELECT id FROM changed)""", _CHANGED, _SAVED),
    "own_counters": _t("SELECT * FROM dmc WHERE NOT (instance_id = 'i3' AND partition IN ('n1', 'n10', 'new')) UNION ALL SELECT unnest(['n1', 'n10', 'new']), 'i3', 500"),
    "dirty_rule": _t("""SELECT 'save True' AS how, id, true AS _dirty FROM base UNION ALL SELECT 'save False', id, false FROM base UNION ALL SELECT 'save None', id, k % 3 = 0 OR k % 2 = 0 FROM base
UNION ALL SELECT 'update True', id, k % 2 = 0 FROM base WHERE k % 3 <> 0 UNION ALL SELECT 'update False', id, k % 2 = 0 AND k % 4 <> 0 FROM base WHERE k % 3 <> 0 UNION ALL SELECT 'update None', id, k % 2 = 0 FROM base WHERE k % 3 <> 0"""),
    "deserialize_apps": f"WITH {_RESTORED} {_APPS}",
    "deserialize_marks": f"WITH {_RESTORED} {_MARKS}",
    "skip_erroring": "SELECT 'u' || c_custkey AS id FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 4 <> 0 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 3 <> 0",
    "restore_levels": _NODES,
    "certificate_chains": f"""WITH RECURSIVE {_TREE}, c AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'n1' WHEN id % 5 = 0 THEN 'n12' ELSE 'n' END AS r, id % 11 = 0 AS w FROM tree),
v AS (SELECT id, r, w, true AS valid FROM c WHERE parent_id IS NULL UNION ALL SELECT c.id, c.r, c.w, v.valid AND starts_with(c.r, v.r) AND (v.w OR (NOT c.w AND starts_with(c.r, v.r))) FROM v JOIN c ON c.parent_id = v.id) SELECT id, valid FROM v""",
    "page_files": _t("SELECT model_uuid, serialized, page, (SELECT count(*) FROM rmcb WHERE rmcb.model_uuid = x.model_uuid)::INT AS entries FROM (SELECT model_uuid, serialized, (row_number() OVER (ORDER BY model_uuid) - 1) // 100 AS page FROM buffer) x WHERE page >= 2"),
    "stream_store": _t(_ORDERED, CLS),
    "stream_counters": _t(_DMC_PARTS, _wire("dmc", "ws")),
    "stream_sessions": _t(f"SELECT * FROM {_LAST}", _meeting()),
    "change_feed": _t(f"""SELECT {_ROW}, dirty_bit, 2::BIGINT AS _version FROM {_LAST} WHERE id IN (SELECT model_uuid FROM c0 WHERE class <> 'REVERSE_FF' UNION SELECT model_uuid FROM c1 WHERE class <> 'REVERSE_FF' UNION SELECT model_uuid FROM c2 WHERE class <> 'REVERSE_FF')
UNION ALL SELECT {_ROW}, false, 3 FROM {_LAST} WHERE id < '1'""", _meeting()),
    "pull_pages": _t("SELECT model_uuid, serialized, page, (SELECT count(*) FROM rmcb WHERE rmcb.model_uuid = x.model_uuid)::INT AS entries FROM (SELECT model_uuid, serialized, (row_number() OVER (ORDER BY model_uuid) - 1) // 50 AS page FROM buffer) x WHERE page >= 7"),
    "bucketed_store": _t(_ORDERED, CLS),
    "observed_transfer": _t(f"SELECT '{SESSION}' AS transfer_session_id, count(*) AS records, sum(strlen(serialized) + strlen(conflicting_serialized_data))::BIGINT AS bytes FROM buffer"),
    "state_store": _t(_ORDERED, CLS),
    "latest_sessions": f"WITH {_SYNCS} SELECT sync_session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY sync_session_id ORDER BY last_activity DESC, id DESC) AS n FROM transfers WHERE active) WHERE n = 1",
    "readable_buffers": _t("SELECT model_uuid, source_id AS transfer_session_id FROM buffer WHERE k % 3 <> 0 AND k % 2 <> 0"),
    "partitions_outside": _t("SELECT DISTINCT partition FROM ws WHERE side = 'sub' AND NOT starts_with(partition, 'n10') AND NOT starts_with(partition, 'n3:c1')", _wire("dmc", "ws")),
    "scope_filters": "SELECT c_custkey, 'n' || c_nationkey || ':' || c_custkey || ':${other}' AS prefix FROM customer",
    "short_names": _t(f"SELECT id, CASE WHEN n >= 65536 THEN {_quint('(n >> 16)')} ELSE '' END || {_quint('n')} AS name FROM (SELECT id, ('0x' || substr(id, 1, 8))::BIGINT AS n FROM base)"),
    "restore_rows": _t("""SELECT id, k, 1 AS v, CASE WHEN k % 9 = 0 THEN '{"k": "Not nine."}' END AS error FROM store WHERE dirty_bit AND NOT deleted AND NOT hard_deleted"""),
    "buffer_page": _t(f"SELECT transfer_session_id, model_uuid, {_RECORD} FROM buffer ORDER BY model_uuid LIMIT 500 OFFSET 500"),
    "buffer_chunks": _t("SELECT model_uuid, (row_number() OVER (ORDER BY model_uuid) - 1) // 500 AS page FROM buffer"),
    "wire_lists": _t(f"SELECT model_uuid, serialized, (SELECT string_agg(instance_id || ':' || counter || ':{SESSION}:' || model_uuid, ' ' ORDER BY instance_id, counter) FROM rmcb WHERE rmcb.model_uuid = b.model_uuid) AS entries FROM buffer b"),
    "wire_nest": _t("SELECT * FROM rmcb"),
    "stale_cleanup": f"""WITH {_SYNCS}, closed AS (SELECT t.* FROM transfers t JOIN syncs s ON s.id = t.sync_session_id WHERE s.active AND t.active AND t.last_activity < TIMESTAMP '1998-01-01' - INTERVAL 6 HOUR AND starts_with(filter, 'n1'))
SELECT 'transfer' AS kind, id FROM closed UNION ALL SELECT 'sync', id FROM syncs s WHERE active AND last_activity < TIMESTAMP '1998-01-01' - INTERVAL 6 HOUR
  AND NOT EXISTS (SELECT 1 FROM transfers t WHERE t.active AND t.sync_session_id = s.id AND t.id NOT IN (SELECT id FROM closed))""",
    "buffer_counts": _t(f"SELECT '{SESSION}' AS transfer_session_id, (SELECT count(*) FROM buffer) AS buffers, (SELECT count(*) FROM rmcb) AS vectors UNION ALL SELECT 't9', 0, 0"),
    "session_clear": _t("SELECT 't9' AS transfer_session_id, model_uuid FROM buffer WHERE deleted"),
    "page_sessions": _t("SELECT profile, count(DISTINCT transfer_session_id) AS n FROM buffer GROUP BY 1"),
}
ORACLES["stream_expiry"] = ORACLES["stale_cleanup"]
