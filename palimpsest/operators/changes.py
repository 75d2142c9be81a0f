"""A feed of inserts, updates and deletes applied to the present state, column by column, in SQL.

For each field the last writer wins: ``max_by`` over the changes that write it.
A CREATE writes every field (null where it has none), a DELETE ends the row, an
UPDATE writes only its non-null fields.  A field whose last writer is an UPDATE
therefore was written after the latest CREATE or DELETE, and a row lives if the
latest of these two is a CREATE.  One grouping does it all, with partial sums
before the shuffle; repeats and disorder change nothing, so no row of a hot key
has to be sorted or brought together.

Changes without an instant, with a null key or with an operation that is none of
the four are left out.  CREATE and UPDATE need a readable JSON object (one
wrapped once more as a JSON string is readable).  Equal instants are ordered by
device, then event id; a null device comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

FIELDS = {"content": "string", "importance": "double", "veracity": "string", "source": "string"}

_READ = """
with feed as (
  select memory_id, operation, event_id, struct(instant_us, device_id, event_id) as at, try_parse_json(payload) as raw
  from {events} where instant_us is not null and memory_id is not null and event_id is not null
    and operation in ('CREATE', 'UPDATE', 'DELETE', 'CONSOLIDATE')
), opened as (
  select *, case when schema_of_variant(raw) = 'STRING' then try_parse_json(variant_get(raw, '$', 'string')) else raw end as body from feed
), changes as (
  select memory_id, operation, event_id, at, body,
         operation = 'CREATE' as creates, operation in ('CREATE', 'UPDATE') as writes
  from opened where operation not in ('CREATE', 'UPDATE') or coalesce(schema_of_variant(body) like 'OBJECT%', false)
), fields as (
  select memory_id, operation, event_id, at, creates, writes, {extracts} from changes
)
"""

_FOLD = """
select memory_id, last_event_id, content_event_id, consolidated, {names}
from (
  select memory_id,
    max_by(creates, at) filter (where operation in ('CREATE', 'DELETE')) as alive,
    max_by(event_id, at) as last_event_id,
    max_by(case when content is not null then event_id end, at) filter (where writes and (creates or content is not null)) as content_event_id,
    coalesce(max(at) filter (where operation = 'CONSOLIDATE') > max(at) filter (where operation in ('CREATE', 'DELETE')), false) as consolidated,
    {folds}
  from fields group by memory_id
) where alive
"""


def present_state(events: DataFrame) -> DataFrame:
    """Live rows: memory_id, last_event_id, content_event_id, consolidated and the fields.

    ``events`` has event_id, memory_id, operation, device_id, payload, instant_us.
    """
    extracts = ", ".join(f"try_variant_get(body, '$.{n}', '{t}') as {n}" for n, t in FIELDS.items())
    folds = ", ".join(f"max_by({n}, at) filter (where writes and (creates or {n} is not null)) as {n}" for n in FIELDS)
    query = _READ.format(events="{events}", extracts=extracts) + _FOLD.format(names=", ".join(FIELDS), folds=folds)
    return events.sparkSession.sql(query, events=events)
