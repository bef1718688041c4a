"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import fixed
from ..functions.scrub import STEPS
from ..operators.scoring import Scoring
from . import adapters


def _s(value) -> str:
    return "null" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(map(_s, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def _list(values: tuple) -> str:
    return "[" + ", ".join(map(_s, values)) + "]"


def _pick(values: tuple, at: str) -> str:
    return f"{_list(values)}[({at}) % {len(values)} + 1]"


def _json(x: str) -> str:
    """A JSON string in ASCII; null is null."""
    one = (
        "case when c = '' then '' when c in ('\"', chr(92)) then chr(92) || c when c = chr(10) then '\\n' when c = chr(13) then '\\r' when c = chr(9) then '\\t' when c = chr(8) then '\\b' when c = chr(12) then '\\f' "
        "when unicode(c) between 32 and 126 then c "
        "when unicode(c) >= 65536 then printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) else printf('\\u%04x', unicode(c)) end"
    )
    return f"coalesce('\"' || array_to_string(list_transform(string_split({x}, ''), lambda c: {one}), '') || '\"', 'null')"


TURNS = "(select conv_id, turn, case role when 'user' then 'human' else 'gpt' end as r, text from conversations where role in ('user', 'assistant'))"
CANON = f"""(select conv_id, count(*) as n, '[' || string_agg('{{"from": "' || r || '", "value": ' || {_json("text")} || '}}', ', ' order by turn) || ']' as canon from {TURNS} group by conv_id)"""
SHARD = "printf('%02x', ('0x' || substr(sha256({0}), 1, 2))::int)"
TIER = "case when toxic = 1 then 'review_needed' when quality = 1 and n_chars > 2000 then 'gold' when quality = 1 then 'silver' when quality = 0 then 'bronze' end"
DATASET = f"""(select d.doc_id, 'record_' || substr(sha256(text), 1, 12) as record_id, source as model_name, source as model_slug, coalesce({TIER}, 'review_needed') as tier,
  {SHARD.format("'record_' || substr(sha256(text), 1, 12)")} as shard, (n_chars % 10001) / 10000.0::double as score, lang,
  case when d.doc_id % 3 > 0 then {_pick(adapters.GPUS, "d.doc_id")} end as gpu_name, n_chars
  from documents d left join labels l on d.doc_id = l.doc_id)"""
TIERS = f"(select model_slug, tier, count(*) as record_count, coalesce((2 * sum(round(score * 10000)::bigint) + count(score))::bigint // (2 * count(score)) / 10000.0::double, 0.0) as avg_quality_score, list_sort(list_distinct(list(shard))) as shards from {DATASET} group by 1, 2)"
RANK = "case tier when 'gold' then 4 when 'silver' then 3 when 'bronze' then 2 when 'review_needed' then 1 else 0 end"
AVERAGE = "coalesce(printf('%.2f', avg(avg_quality_score) filter (avg_quality_score > 0)), 'N/A')"
DISTRIBUTION = f"(select tier, sum(n)::bigint as record_count from (select tier, record_count as n from {TIERS} union all select t, 0 from (values ('gold'), ('silver'), ('bronze'), ('review_needed')) v(t)) group by 1)"
#: Turns numbered from 0 with the tool calls that sample records have.
NUMBERED = f"(select *, row_number() over (partition by conv_id order by turn) - 1 as i from {TURNS})"
CALLS = f"(select conv_id, i, unnest(range(1, i % 3 + 1)) as j from {NUMBERED} where r = 'gpt')"
STATUS = _pick(fixed.TOOL_STATUSES, "conv_id + i + j")
RATING = "(conv_id % 7)::int"
TAGS = f"[{_pick(fixed.OUTCOME_TAGS, 'conv_id')}, case when conv_id % 11 = 0 then 'not_a_tag' else {_pick(fixed.OUTCOME_TAGS, 'conv_id * 7')} end]"
MODEL = _pick(adapters.MODELS, "conv_id")
PROVIDER = f"case when conv_id % 13 = 0 then 'cloud' else {_pick(fixed.PROVIDERS, 'conv_id')} end"
ERRORS = f"""array_to_string(list_filter([case when conv_id % 7 = 0 then 'turn_count' end, case when conv_id % 13 = 0 then 'provider' end, case when conv_id % 7 not between 1 and 5 then 'user_rating' end, case when conv_id % 11 = 0 then 'outcome_tags' end], lambda x: x is not null), ',')"""
CREATED = "strftime(timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 60), '{0}')"
JITTER = "(('0x' || substr(sha256(canon), 1, 15))::bigint % 3601 - 1800)"


def _scrubbed(source: str, columns: str) -> str:
    """Nested sub-queries, one for each pattern, each on the text of the one before."""
    sql, sums = source, {}
    for i, (category, pattern, to) in enumerate(STEPS[:-1]):
        sql = f"(select * replace (regexp_replace(text, {_s(pattern)}, {_s(to)}, 'g') as text), coalesce(len(regexp_extract_all(text, {_s(pattern)})), 0) as n{i} from {sql})"
        sums.setdefault(category, []).append(f"n{i}")
    counts = ", ".join(f"({' + '.join(v)})::bigint as {c}" for c, v in sums.items())
    return f"(select {columns}, {counts} from {sql})"


def _gpu(name: str) -> str:
    return "case when {0} is null then null ".format(name) + " ".join(f"when regexp_matches({name}, {_s(p)}, 'i') then {_s(f)}" for p, f in fixed.GPU_FAMILIES) + f" else {_s(fixed.OTHER_GPU)} end"


def _memory(value: str) -> str:
    return f"case when {value} is null then null when {value} <= 0 then 4 " + " ".join(f"when {value} <= {t} then {t}" for t in fixed.MEMORY_TIERS) + " else 512 end::int"


def _os(name: str) -> str:
    low = f"lower({name})"
    return f"case when contains({low}, 'darwin') or contains({low}, 'mac') then 'macos' when contains({low}, 'linux') then 'linux' when contains({low}, 'win') then 'windows' else {name} end"


def _slug(name: str) -> str:
    s = f"regexp_replace(lower(regexp_replace({name}, '^\\s+|\\s+$', '', 'g')), '[\\s._]+', '-', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({s}, '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


def _consent(level: str) -> str:
    gone, text_only, no_text = level == "anonymous", level == "trajectory_only", level == "metadata_only"
    null = lambda x, kind="varchar": f"null::{kind}"
    created = _s(adapters.NOW) if gone or text_only else CREATED.format("%Y-%m-%d %H:%M:%S")
    last_call = f"(select max(i) from {NUMBERED} t where t.conv_id = c.conv_id)"
    has_call = f"exists (select 1 from {CALLS} k where k.conv_id = c.conv_id and k.i = {last_call})"
    return f"""select conv_id, {created} as created_at, {null('') if gone else MODEL} as model_name, {null('') if gone or text_only else PROVIDER} as provider,
  {null('') if gone or text_only else _pick(adapters.SYSTEMS, 'conv_id')} as os, {null('', 'int') if gone else RATING} as user_rating, {'null::int' if gone else '1'} as pain_points,
  {null('') if gone or text_only else "'c' || conv_id::varchar"} as contributor_id, {null('') if gone else "'1.0'"} as agent_version,
  {_s(fixed.REDACTED_CONTENT) if no_text else f"(select text from {NUMBERED} t where t.conv_id = c.conv_id and t.i = 0)"} as first_value,
  case when {has_call} then {_s(fixed.REDACTED_CONTENT) if no_text else "'in'"} else '' end as tool_input, case when {has_call} then 'tool1' else '' end as tool_name
from (select distinct conv_id from {TURNS}) c"""


def _score() -> str:
    s = Scoring()
    total = sum(s.weights.values())
    parts = {
        "coherence": "(select count(*) filter (i = 0 or r <> before)::double / count(*) from w where w.conv_id = c.conv_id)",
        "tool_validity": f"coalesce((select count(*) filter ({STATUS} = 'success')::double / nullif(count(*), 0) from k where k.conv_id = c.conv_id), 1.0)",
        "outcome_quality": f"(({RATING} - 1) / 4.0)::double",
        "information_density": "(select least(1.0, sum(words)::double / (greatest(count(*), 1) * 40.0::double)) from w where w.conv_id = c.conv_id)",
        "metadata_completeness": "(2 / 4.0)::double",
    }
    score = " + ".join(f"{parts[k]} * {w / total!r}::double" for k, w in s.weights.items())
    tiers = " ".join(f"when score >= {least} then {_s(t)}" for t, least in s.limits.items())
    return f"""with w as (select *, lag(r) over (partition by conv_id order by i) as before, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words from {NUMBERED}),
k as (select * from {CALLS}), c as (select distinct conv_id from {TURNS}), scored as (select conv_id, round({score}, 6) as score from c)
select conv_id, score, case {tiers} else 'review_needed' end as tier from scored"""


def _submitted(columns: str, scored: str) -> str:
    """Sample records by their own consent level, after consent: what of the canonical turns, model, hardware and outcome is left."""
    level = _pick(fixed.CONSENT_LEVELS, "conv_id")
    redacted = f"""(select conv_id, '[' || string_agg('{{"from": "' || r || '", "value": "{fixed.REDACTED_CONTENT}"}}', ', ' order by turn) || ']' as redacted from {TURNS} group by conv_id)"""
    return f"""with w as (select *, lag(r) over (partition by conv_id order by i) as before, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words from {NUMBERED}),
k as (select * from {CALLS}),
c as (select conv_id, {level} as level, case when {level} = 'metadata_only' then redacted else canon end as canon, case when {level} = 'anonymous' then null else {MODEL} end as model,
  case when {level} = 'anonymous' then null else {RATING} end as rating, case when {level} = 'anonymous' then null else {TAGS} end as tags,
  case when {level} in ('anonymous', 'trajectory_only') then null else {_gpu(_pick(adapters.GPUS, "conv_id"))} end as gpu_name from {CANON} join {redacted} using (conv_id)),
scored as (select *, {scored} as score from c)
select {columns} from scored c"""


def _after_consent() -> str:
    """The score of records after consent, as _score() has it before."""
    s = Scoring()
    total = sum(s.weights.values())
    parts = {
        "coherence": "(select count(*) filter (i = 0 or r <> before)::double / count(*) from w where w.conv_id = c.conv_id)",
        "tool_validity": f"coalesce((select count(*) filter ({STATUS} = 'success')::double / nullif(count(*), 0) from k where k.conv_id = c.conv_id), 1.0)",
        "outcome_quality": "coalesce((rating - 1) / 4.0, 0.5)::double",
        "information_density": "(select least(1.0, sum(case when c.level = 'metadata_only' then 1 else words end)::double / (greatest(count(*), 1) * 40.0::double)) from w where w.conv_id = c.conv_id)",
        "metadata_completeness": "((model is not null)::int + (gpu_name is not null)::int) / 4.0::double",
    }
    return "round(" + " + ".join(f"{parts[k]} * {w / total!r}::double" for k, w in s.weights.items()) + ", 6)"


TIER_OF = "case " + " ".join(f"when score >= {least} then {_s(t)}" for t, least in Scoring().limits.items()) + " else 'review_needed' end"
RECORD_ID = "'record_' || substr(sha256(canon), 1, 12)"
SUBMISSION = f"""'sha256:' || sha256('{{"model_name": ' || {_json("model")} || ', "rating": ' || coalesce(rating::varchar, 'null') || ', "tags": ' || coalesce('[' || array_to_string(list_transform(list_sort(tags), lambda t: '"' || t || '"'), ', ') || ']', 'null') || ', "trajectory": ' || canon || '}}')"""

#: Sample records with their ids, as the dataset places them.
PLACED = f"(select conv_id, {RECORD_ID} as record_id, {MODEL} as model, coalesce(nullif({_slug(MODEL)}, ''), 'unknown') as model_slug, 'review_needed' as tier, n as turns from {CANON})"
#: Records of a store after two publishes: even ids, then all.
STORED = f"(select * from {DATASET} qualify row_number() over (partition by model_slug, tier, record_id order by doc_id % 2, doc_id) = 1)"
#: Addresses in a text, by RE2: a mark goes between a version word and the numbers after it, and numbers with the mark before them are none.
MARK = "chr(1)"
_VERSIONS = "|".join(rf"(?i:{w.replace('.', chr(92) + '.')})\s{{0,{fixed.VERSION_REACH - len(w)}}}" for w in sorted(fixed.VERSION_WORDS, key=len, reverse=True))


def _marked(text: str) -> str:
    return f"regexp_replace({text}, '({_VERSIONS})({fixed.IPV4})', '\\1' || {MARK} || '\\2', 'g')"


def _no_addresses(text: str) -> str:
    """Two passes: neighbours share the character between them."""
    out = _marked(text)
    for _ in range(2):
        out = f"regexp_replace({out}, '(^|[^.0-9' || {MARK} || '])' || {_s(fixed.IPV4)} || '($|[^.0-9])', '\\1{fixed.IP_PLACEHOLDER}\\3', 'g')"
    return f"replace({out}, {MARK}, '')"


def _steps_of(source: str) -> str:
    """(category, replacement, original) of all redactions, step by step."""
    sql, parts = source, []
    for i, (category, pattern, to) in enumerate(STEPS[:-1]):
        parts.append(f"select {_s(category)} as category, {_s(to)} as replacement, unnest(regexp_extract_all(text, {_s(pattern)})) as original from t{i}")
        sql += f", t{i + 1} as (select regexp_replace(text, {_s(pattern)}, {_s(to)}, 'g') as text from t{i})"
    doubled = f"regexp_replace({_marked('text')}, '([^0-9.])', '\\1\\1', 'g')"
    parts.append(f"select 'network', {_s(fixed.IP_PLACEHOLDER)}, unnest(regexp_extract_all({doubled}, '(?:^|[^.0-9' || {MARK} || '])' || {_s(fixed.IPV4)} || '(?:$|[^.0-9])', 1)) from t{len(STEPS) - 1}")
    return f"with {sql}, found as ({' union all '.join(parts)})"


def _all_steps(source: str) -> str:
    """(doc_id, clean, counts) of all steps over source (doc_id, text)."""
    marks = lambda x: f"len(regexp_extract_all({x}, {_s(chr(92) + '[REDACTED_IP' + chr(92) + ']')}))"
    addresses = f"coalesce({marks('clean')} - {marks('scrubbed')}, 0)"
    counts = ", ".join(f"({c}{' + ' + addresses if c == 'network' else ''})::bigint as {c}" for c in fixed.CATEGORIES)
    return f"(select doc_id, clean, {counts} from (select *, {_no_addresses('scrubbed')} as clean from (select doc_id, text as scrubbed, {', '.join(fixed.CATEGORIES)} from {_scrubbed(source, 'doc_id, text')})))"


def _spans() -> str:
    """Places of all redactions: a step's matches and what lies between them, by running lengths. For addresses all else but digits and points is doubled, as neighbours share a character, and counts half."""
    sql, parts = "t0 as (select doc_id, text from documents)", []
    width = lambda x: f"len({x})"
    half = lambda x: f"(len(regexp_replace({x}, '[^0-9.]', '', 'g')) + len(regexp_replace({x}, '[0-9.]', '', 'g')) / 2)"
    for i, (category, pattern, to) in enumerate(STEPS):
        last = i == len(STEPS) - 1
        p = f"'(?:^|[^.0-9])' || {_s(fixed.IPV4)} || '(?:$|[^.0-9])'" if last else _s(pattern)
        text = "regexp_replace(text, '([^0-9.])', '\\1\\1', 'g')" if last else "text"
        size = half if last else width
        before = f"list_aggregate(list_transform(gaps[1 : k] || found[1 : k - 1], lambda x: {size('x')}), 'sum')"
        # an address is found with its neighbours, half of each pair
        lead = "case when regexp_matches(found[k], '^[^0-9]') then 0.5 else 0 end" if last else "0"
        core = "regexp_extract(found[k], '^[^0-9]?(.*?)[^0-9]?$', 1)" if last else "found[k]"
        parts.append(
            f"select doc_id, {i} as step, {_s(category)} as category, ({before} + {lead})::int as start_at, ({before} + {lead} + len({core}))::int as end_at, {core} as original, {_s(to)} as replacement, (len(found) - k)::int as place, true as held "
            f"from (select *, unnest(range(1, len(found) + 1)) as k from (select doc_id, regexp_extract_all({text}, {p}) as found, regexp_split_to_array({text}, {p}) as gaps from t{i}) where len(found) > 0)"
        )
        if not last:
            sql += f", t{i + 1} as (select doc_id, regexp_replace(text, {_s(pattern)}, {_s(to)}, 'g') as text from t{i})"
    return f"with {sql} {' union all '.join(parts)}"


EVENTS = """with ev as (select 'u' || user_id::varchar as session_id, user_id, event_id as seq, event_type as t, floor(value % 7)::int as rating, props, ts from events),
began as (select session_id, coalesce(max(seq) filter (t = 'signup'), -1) as b from ev group by 1),
since as (select ev.* from ev join began using (session_id) where seq >= b),
built as (select session_id, count(*) filter (t in ('view', 'click')) as turn_count, count(*) filter (t = 'click' and seq % 2 = 0) as total_tool_calls,
  count(*) filter (t = 'click' and seq % 2 = 0 and seq % 3 > 0) as successful_tool_calls, max(case when t = 'signup' then case when user_id % 7 > 0 then 'model ' || (user_id % 7)::varchar else 'unknown' end end) as model_name,
  max(case when t = 'signup' then 'NVIDIA RTX 4090' end) as gpu_name, max(case when t = 'signup' then ts end) as started,
  max(seq) filter (t = 'purchase' and rating between 1 and 5 and seq % 5 > 0) as rated, max(seq) filter (t not in ('view', 'click', 'signup', 'purchase')) as reported, min(seq) filter (t = 'click' and seq % 2 = 0) as called
  from since group by 1)"""


def _session_scores() -> str:
    s = Scoring()
    total = sum(s.weights.values())
    parts = {
        "coherence": "case when turn_count > 0 then (select count(*) filter (before is null or before <> t)::double / count(*) from turns w where w.session_id = c.session_id) else 0.0 end",
        "tool_validity": "case when total_tool_calls > 0 then successful_tool_calls::double / total_tool_calls else 1.0 end",
        "outcome_quality": "coalesce(((select rating from since e where e.session_id = c.session_id and e.seq = c.rated) - 1) / 4.0, 0.5)::double",
        "information_density": "(select least(1.0, coalesce(sum(words), 0)::double / (greatest(count(*), 1) * 40.0::double)) from turns w where w.session_id = c.session_id)",
        "metadata_completeness": "((model_name is not null)::int + (gpu_name is not null)::int) / 4.0::double",
    }
    score = " + ".join(f"{parts[k]} * {w / total!r}::double" for k, w in s.weights.items())
    return f"""{EVENTS}, turns as (select session_id, t, lag(t) over (partition by session_id order by seq) as before, len(list_filter(regexp_split_to_array(props, '\\s+'), lambda x: x <> '')) as words from since where t in ('view', 'click')),
scored as (select *, round({score}, 6) as score from built c), routed as (select session_id, {TIER_OF} as tier, case when {TIER_OF} in ('gold', 'silver') then 'outbox' else 'staging' end as place from scored)"""


RATED = f"""(select conv_id, max(turn) as seq from conversations where conv_id % 3 = 0 and (conv_id + turn) % 7 between 1 and 5 and (turn % 4 = 0 or (conv_id + turn) % 5 > 0) group by 1)"""
DECIDED = f"""(select conv_id, case when conv_id <= (select max(conv_id) from {TURNS} where conv_id = 5) then 'not reviewed' when conv_id % 4 = 0 then 'approve' when conv_id % 4 = 1 then 'reject' else 'skip' end as action from (select distinct conv_id from {TURNS}))"""

SESSIONS = """with ev as (select 'u' || user_id::varchar as session_id, event_id as seq, event_type as t, floor(value % 7)::int as rating from events),
began as (select session_id, coalesce(max(seq) filter (t = 'signup'), -1) as b from ev group by 1),
since as (select ev.*, count(*) filter (t in ('view', 'click')) over (partition by session_id order by seq) as turns from ev join began using (session_id) where seq >= b)
select session_id, count(*) filter (t in ('view', 'click')) as n_turns, arg_max(rating, seq) filter (t = 'purchase' and rating between 1 and 5 and seq % 5 > 0) as user_rating,
  count(*) filter (t not in ('view', 'click', 'signup', 'purchase')) as n_reports, max(greatest(turns - 1, 0)) filter (t not in ('view', 'click', 'signup', 'purchase')) as last_turn_index, {0} as ended
from since group by 1"""

#: Addresses by document, without the rule about version words, which no supplied document meets.
IPS = f"""select doc_id, n::bigint as n from (select doc_id, len(regexp_extract_all(regexp_replace(text, '([^0-9.])', '\\1\\1', 'g'), '(?:^|[^.0-9]){fixed.IPV4}(?:$|[^.0-9])')) as n from documents) where n > 0"""

ORACLES: dict[str, str] = {
    "trajectory_shard_counts": f"select {SHARD.format('id')} as shard, count(*) as n from (select 'record_' || substr(sha256(canon), 1, 12) as id from {CANON}) group by 1",
    "record_ids": f"""select conv_id, n as turn_count, coalesce(dropped, 0) as dropped, 'record_' || substr(sha256(canon), 1, 12) as record_id from {CANON}
  left join (select conv_id, count(*) as dropped from conversations where role not in ('user', 'assistant') group by 1) using (conv_id)""",
    "submission_hashes": f"""select conv_id, 'sha256:' || sha256('{{"model_name": ' || {_json(MODEL)} || ', "rating": ' || {RATING}::varchar || ', "tags": [' || array_to_string(list_transform(list_sort({TAGS}), lambda t: '"' || t || '"'), ', ') || '], "trajectory": ' || canon || '}}') as submission_hash from {CANON}""",
    "sharegpt_turns": f"select conv_id, i as pos, r as role, text as value from {NUMBERED}",
    "dpo_pairs": f"select conv_id, coalesce(arg_min(text, i) filter (r = 'human' and text <> ''), '') as prompt, coalesce(string_agg(text, chr(10) order by i) filter (r = 'gpt'), '') as response from {NUMBERED} group by 1",
    "turn_previews": f"""select conv_id, arg_min(p, i) as first_turn, arg_max(p, i) as last_turn from (select *, case when length(text) > 200 then left(text, 200) || '...' else text end as p from {NUMBERED}) group by 1""",
    "tool_call_counts": f"""select c.conv_id, count(j) as total_tool_calls, count(j) filter ({STATUS.replace("conv_id", "c.conv_id")} = 'success') as successful_tool_calls, count(j) filter ({STATUS.replace("conv_id", "c.conv_id")} <> 'success') as failed_tool_calls
  from (select distinct conv_id from {TURNS}) c left join {CALLS} k on c.conv_id = k.conv_id group by 1""",
    "validation_errors": f"select distinct conv_id, {ERRORS} as errors from {TURNS}",
    "history_rows": f"select 'record_' || substr(sha256(canon), 1, 12) as record_id, 'task_trajectory' as record_type, n as turn_count, {CREATED.format('%Y-%m-%dT%H:%M:%S')} as created_at, '?' as tier, '-' as score from {CANON}",
    "scrub_counts_by_category": "select unnest(['" + "', '".join(fixed.CATEGORIES) + "']) as category, unnest([" + ", ".join(f"sum({c})::bigint" for c in fixed.CATEGORIES) + f"]) as n from {_all_steps('(select doc_id, text from documents)')}",
    "scrub_text_hash": f"select doc_id, sha256(clean) as hash from {_all_steps('(select doc_id, text from documents)')}",
    "redaction_spans": _spans(),
    "scrub_ips": IPS,
    "scrub_literals": f"select doc_id as id, sha256(clean) as hash, {', '.join(fixed.CATEGORIES)} from {_all_steps('(select doc_id, ' + _pick(tuple(r[1] for r in adapters.SCRUB_LITERALS), 'doc_id') + ' || chr(10) || text as text from documents)')}",
    "scrub_ip_literals": f"select doc_id as id, {_pick(tuple(r[2] for r in adapters.IP_LITERALS), 'doc_id')} || chr(10) || source as text from documents",
    "org_domain_flags": f"""select id, domains from (values {_values(tuple((i, e) for i, _, e in adapters.DOMAIN_LITERALS))}) v(id, domains)
  union all select doc_id + 1000, array_to_string(d, ',') from (select doc_id, list_filter(regexp_extract_all(text, {_s(fixed.ORG_DOMAIN)}), lambda x: lower(x) not in ({', '.join(map(_s, fixed.SAFE_DOMAINS))})) as d from documents) where len(d) > 0""",
    "gpu_families": f"select doc_id, {_gpu('gpu')} as family from (select doc_id, {_pick(tuple(r[1] for r in adapters.HARDWARE_LITERALS), 'doc_id')} || ' in ' || source as gpu from documents)",
    "memory_tiers": f"select doc_id, {_memory('(n_chars % 700 - 5)')} as vram, {_memory('n_chars')} as ram from documents",
    "os_families": f"select doc_id, {_os('os')} as os from (select doc_id, {_pick(tuple(r[4] for r in adapters.HARDWARE_LITERALS), 'doc_id')} || ' ' || lang as os from documents)",
    "hardware_anonymized": f"""select distinct conv_id, {_gpu(_pick(adapters.GPUS, 'conv_id'))} as gpu_name, {_memory('(conv_id % 90)')} as gpu_vram_gb, {_memory('(conv_id * 7 % 700)')} as ram_gb, {_os(_pick(adapters.SYSTEMS, 'conv_id'))} as os, null::varchar as cuda_version from {TURNS}""",
    "tier_thresholds": f"select tier, least, {RANK} >= {RANK.replace('case tier', 'case least')} as meets, count(*) as n from (select tier, {_pick((*fixed.TIER_RANKS, 'none'), 'doc_id')} as least from {DATASET}) group by 1, 2, 3",
    "jitter_offsets": f"select conv_id, {JITTER} as seconds from {CANON}",
    "model_slugs": f"select name, {_slug('name')} as slug from ((select name from (values {_values(adapters.SLUG_LITERALS)}) v(name)) union all (select distinct source from documents))",
    "record_paths": f"""select doc_id, 'data/' || case when doc_id % 5 > 0 then model_slug else 'unknown' end || '/' || case when doc_id % 4 > 0 then tier else 'review_needed' end || '/shard_' || shard || '.jsonl' as path from {DATASET}""",
    "dedup_insert_if_absent": f"""with d as (select * from {DATASET}), e as (select distinct model_slug, tier, record_id from d where doc_id % 2 = 0)
  select min(doc_id) as doc_id, model_slug, tier, record_id from d anti join e using (model_slug, tier, record_id) where doc_id % 2 = 1 or doc_id % 3 = 0 group by 2, 3, 4""",
    "outbox_upsert": f"select record_id, max(doc_id) as doc_id, arg_max(lang, doc_id) as lang from {DATASET} group by 1",
    "active_records": f"with d as (select * from {DATASET}) select model_slug, count(*) as n from d where record_id not in (select record_id from d where tier = 'review_needed' and doc_id % 2 = 0) group by 1",
    "tier_stats": f"select model_slug, tier, record_count, avg_quality_score, array_to_string(shards, ',') as shards from {TIERS}",
    "model_stats": f"""with d as (select *, case when doc_id % 4 = 0 then upper(model_name) || ' ' || tier else model_name end as name, row_number() over (partition by model_slug order by tier, shard, doc_id) as place from {DATASET}),
  langs as (select model_slug, string_agg(lang, ',' order by f) as langs from (select model_slug, lang, min(place) as f from d group by 1, 2) group by 1),
  gpus as (select model_slug, string_agg(gpu_name || '=' || n::varchar, ',' order by gpu_name) as hardware from (select model_slug, gpu_name, count(*) as n from d where gpu_name is not null group by 1, 2) group by 1)
  select model_slug, count(*) as total_records, coalesce(arg_min(name, place) filter (name <> model_slug), model_slug) as display_name, any_value(langs) as langs, any_value(hardware) as hardware from d left join langs using (model_slug) left join gpus using (model_slug) group by model_slug""",
    "quality_distribution": f"select * from {DISTRIBUTION}",
    "quality_shares": f"select tier, record_count, case when total > 0 then printf('%.1f', record_count / total * 100) else '0.0' end as percentage, {RANK} as rank from (select *, sum(record_count) over ()::double as total from {DISTRIBUTION})",
    "catalog_totals": f"select sum(record_count)::bigint as total_records, 0::bigint as total_size_bytes, (select count(*) from labels where toxic = 1)::bigint as deletions_count from {TIERS}",
    "catalog_rollup": f"select model_slug, tier, count(*) as record_count, grouping(model_slug, tier)::bigint as level from {DATASET} group by rollup (model_slug, tier)",
    "catalog_filter": f"select model_slug, tier, record_count from {TIERS} where contains(model_slug, 'src1') and tier = 'gold'",
    "browse_pivot": f"select model_slug, coalesce(max(record_count) filter (tier = 'gold'), 0) as gold, coalesce(max(record_count) filter (tier = 'silver'), 0) as silver, coalesce(max(record_count) filter (tier = 'bronze'), 0) as bronze, sum(record_count)::bigint as total, {AVERAGE} as average from {TIERS} group by 1",
    "model_summary": f"select model_slug, sum(record_count)::bigint as record_count, {AVERAGE} as average, arg_max(tier, {RANK}) as top_tier from {TIERS} group by 1",
    "model_drill_down": f"select tier, record_count, len(shards)::bigint as n_shards, {RANK} as rank from {TIERS} where model_slug = 'src1'",
    "shard_plan": f"select model_slug, tier, shard, 'data/' || model_slug || '/' || tier || '/shard_' || shard || '.jsonl' as path from (select model_slug, tier, unnest(shards) as shard from {TIERS} where tier = 'gold')",
    "download_plan": f"select tier, count(*) as n from (select tier, unnest(shards) as shard from {TIERS}) where shard >= '80' group by 1",
    "top_sources": "select source, count(*) as n, min(doc_id) as first_seen from documents group by 1 order by n desc, first_seen limit 10",
    "top_tags": f"select tag, count(*) as n, min(place) as first_seen from (select conv_id * 10 + p - 1 as place, {TAGS}[p] as tag from (select distinct conv_id from {TURNS}) cross join (values (1), (2)) v(p)) group by 1 order by n desc, first_seen limit 10",
    "pain_category_counts": f"select {_pick(fixed.PAIN_POINT_CATEGORIES, 'conv_id')} as category, count(*) as n from (select distinct conv_id from {TURNS}) group by 1",
    "submission_tier_counts": f"select '?' as tier, count(*) as n from (select distinct conv_id from {TURNS}) union all select 'error', count(*) from (select distinct conv_id from {TURNS} where {ERRORS} <> '')",
    "activity_summary": "select event_type as action, count(*) as n from events group by 1",
    "byte_labels": "select doc_id, case when n < 1024 then n::varchar || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0::double) else printf('%.1f MB', n / 1048576.0::double) end as label from (select doc_id, n_chars::bigint * (doc_id % 4) * case when doc_id % 7 = 0 then 1280 else 1 end as n from documents)",
    "tag_splits": r"select doc_id, len(found)::bigint as n, sha256(array_to_string(found, '|')) as hash from (select doc_id, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as found from documents)",
    "tool_text_cuts": "select doc_id, sha256(left(text, 2000)) as hash from documents",
    "quality_scores": _score(),
    "sessions_batch": SESSIONS.format("false"),
    "sessions_stream": SESSIONS.format("true"),
    "scrub_summary_rows": "select label, n from (select unnest([" + ", ".join(_s(c.replace("_", " ").title()) for c in fixed.CATEGORIES) + "]) as label, unnest([" + ", ".join(f"sum({c})::bigint" for c in fixed.CATEGORIES) + f"]) as n from {_all_steps('(select doc_id, text from documents)')}) where n > 0",
    "scrub_marker_counts": f"select marker, count(*) as n from (select unnest(regexp_extract_all(clean, '\\[REDACTED_\\w+\\]')) as marker from {_all_steps('(select doc_id, text from documents)')}) group by 1",
    "jittered_times": f"select conv_id, strftime(timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 60) + to_seconds({JITTER}), '%Y-%m-%d %H:%M:%S') as created_at from {CANON}",
    "scrub_record_logs": f"select distinct conv_id, 'see [REDACTED_PATH]' as user_comment, 'at [REDACTED_IP]' as description, 1::bigint as file_paths, 1::bigint as network, 0::bigint as flagged from {TURNS}",
    "scrub_documents": f"""with t as (select doc_id, text as scrubbed, {', '.join(fixed.CATEGORIES)} from {_scrubbed('(select doc_id, text from documents)', 'doc_id, text')}), u as (select *, {_no_addresses('scrubbed')} as clean from t)
  select doc_id, sha256(clean) as hash, {', '.join(f"({c}" + (f" + len(regexp_extract_all(clean, {_s(chr(92) + '[REDACTED_IP' + chr(92) + ']')})) - len(regexp_extract_all(scrubbed, {_s(chr(92) + '[REDACTED_IP' + chr(92) + ']')}))" if c == 'network' else '') + f")::int as {c}_redacted" for c in fixed.CATEGORIES)} from u""",
    "redaction_details": f"{_steps_of('t0 as (select text from documents)')} select category, replacement, count(*) as n, count(distinct original) as n_distinct from found group by 1, 2",
    "submitted_records": _submitted(f"conv_id, {RECORD_ID} as record_id, {SUBMISSION} as submission_hash, {TIER_OF} as tier, gpu_name, case when level <> 'anonymous' then 'see [REDACTED_PATH]' end as user_comment, case when level <> 'anonymous' then 'at [REDACTED_IP]' end as description, 1::int as network_redacted", _after_consent()),
    "exported_records": _submitted(f"conv_id, {RECORD_ID} as record_id, {SUBMISSION} as submission_hash, false as scored, gpu_name", "0"),
    "session_records": f"""{EVENTS} select session_id, turn_count, total_tool_calls, successful_tool_calls, total_tool_calls - successful_tool_calls as failed_tool_calls, model_name, gpu_name,
  coalesce(strftime(started, '%Y-%m-%d %H:%M:%S'), {_s(adapters.NOW)}) as created_at, (select nullif(props, '') from since e where e.session_id = b.session_id and e.seq = b.rated and e.seq % 2 = 0) as user_comment,
  case when reported % 3 = 0 then 'high' when reported is not null then 'medium' end as last_severity,
  (select 'tool' || (seq % 4)::varchar || ' ' || props || ' ' || case when seq % 3 = 0 then 'failure' else 'success' end from since e where e.session_id = b.session_id and e.seq = b.called) as first_call from built b""",
    "session_routes": f"{_session_scores()} select session_id, place, case when place = 'outbox' then tier end as tier from routed",
    "session_activity": f"{_session_scores()} select case when place = 'outbox' then 'auto_submitted' else 'queued_for_review' end as action, tier as quality_tier, count(*) as n from routed group by 1, 2",
    "staged_ratings": f"""select c.conv_id, case when seq is null then {RATING.replace("conv_id", "c.conv_id")} else ((c.conv_id + seq) % 7)::int end as user_rating,
  case when seq is null then array_to_string({TAGS.replace("conv_id", "c.conv_id")}, ',') when seq % 4 > 0 then {_pick(fixed.OUTCOME_TAGS, "c.conv_id + seq")} else '' end as tags,
  case when seq is null then 'see ~/notes/x' when seq % 2 = 0 then 'at ' || seq::varchar end as user_comment from (select distinct conv_id from {TURNS}) c left join {RATED} r on c.conv_id = r.conv_id""",
    "staged_reports": f"""select c.conv_id, {_pick(fixed.PAIN_POINT_CATEGORIES, "c.conv_id")} || ' medium -' || coalesce(',' || added, '') as pain_points from (select distinct conv_id from {TURNS}) c left join
  (select conv_id, string_agg({_pick(fixed.PAIN_POINT_CATEGORIES, "conv_id + turn")} || ' ' || case when turn % 3 = 0 then {_pick(fixed.SEVERITIES, "conv_id + turn")} else 'medium' end || ' -', ',' order by turn) as added
   from conversations where conv_id % 4 = 0 and turn % 5 < 4 and turn % 3 <> 1 group by 1) a on c.conv_id = a.conv_id""",
    "review_decisions": f"select conv_id, action from {DECIDED}",
    "review_summary": f"select count(*) filter (action = 'approve') as approved, count(*) filter (action = 'reject') as rejected, count(*) filter (action = 'skip') as skipped from {DECIDED}",
    "model_details": f"""with d as (select *, row_number() over (order by tier, shard, doc_id) as place from {DATASET} where model_slug = 'src1'),
  langs as (select string_agg(lang, ', ' order by f) as langs from (select lang, min(place) as f from d where lang <> '' group by 1)),
  gpus as (select coalesce(string_agg(gpu_name || ' (' || n::varchar || ')', ', ' order by n desc, gpu_name), '') as hardware from (select gpu_name, count(*) as n from d where gpu_name is not null group by 1 order by n desc, gpu_name limit 5)),
  t as (select string_agg(tier || ' ' || record_count::varchar || ' ' || printf('%.2f', avg_quality_score), ', ' order by {RANK} desc) as tiers from {TIERS} where model_slug = 'src1')
  select 'src1' as model_slug, 'src1' as display_name, coalesce(langs, '---') as langs, (select count(*) from d) as total_records, tiers, hardware from langs cross join gpus cross join t""",
    "available_choices": f"select string_agg(distinct model_slug, ',' order by model_slug) as models, string_agg(distinct tier, ',' order by tier) as tiers from {DATASET}",
    "publish_summary_row": f"""with d as (select * from {DATASET}), e as (select distinct model_slug, tier, record_id from d where doc_id % 2 = 0), n as (select distinct model_slug, tier, record_id from d anti join e using (model_slug, tier, record_id) where doc_id % 2 = 1)
  select count(*) as n_records, array_to_string(list_sort(list_distinct(list(model_slug))), ',') as models, array_to_string(list_sort(list_distinct(list(tier))), ',') as tiers, array_to_string(list_sort(list_distinct(list(model_slug)))[1:5], ',') as first_models from n""",
    "top_hardware": f"select gpu_name, count(*) as n, min(doc_id) as first_seen from {DATASET} where gpu_name is not null group by 1 order by n desc, first_seen limit 5",
    "record_previews": f"""with scored as ({_score()}), p as (select conv_id, count(*) as turns, arg_min(p, i) as first_turn, arg_max(p, i) as last_turn from (select *, case when length(text) > 200 then left(text, 200) || '...' else text end as p from {NUMBERED}) group by 1)
  select conv_id, 'task_trajectory' as record_type, turns + case when conv_id % 7 = 0 then 1 else 0 end as turn_count, '0 total (0 success, 0 failed)' as tool_calls, {MODEL} as model, tier, printf('%.3f', floor(score * 1000 + 0.5 + 1e-7) / 1000) as score, ({RATING})::varchar || '/5' as rating,
  array_to_string({TAGS}, ', ') as tags, 'see [REDACTED_PATH]' as comment, '[medium] ' || {_pick(fixed.PAIN_POINT_CATEGORIES, "conv_id")} || ': at [REDACTED_IP]' as pain_points, '' as flags, first_turn, case when turns > 1 then last_turn end as last_turn from scored join p using (conv_id)""",
    "keyless_sessions": f"""select conv_id, case when conv_id % 4 = 1 then '' when conv_id % 4 = 2 then 'same' when conv_id % 4 = 3 then conv_id::varchar end as session_id, 'outbox' as place, 'mail [REDACTED_EMAIL] key [REDACTED_KEY]' as user_comment, 1::int as emails, 1::int as api_keys from (select distinct conv_id from {TURNS})""",
    "staging_files": f"select conv_id, n + case when conv_id % 7 = 0 then 1 else 0 end as turn_count, {RATING} as user_rating, {MODEL} as model_name, {CREATED.format('%Y-%m-%d %H:%M:%S')} as created_at from {CANON}",
    "outbox_files": f"select {RECORD_ID} as record_id, any_value(n) as turns, 'record_' || {RECORD_ID} || '.jsonl' as file from {CANON} group by 1, 3",
    "shard_files_scan": f"select distinct record_id, model_slug, tier, 'shard_' || {SHARD.format('record_id')} || '.jsonl' as shard, turns from {PLACED}",
    "shard_files_of_model": f"select model_slug, tier, count(distinct record_id) as record_count, count(distinct {SHARD.format('record_id')}) as n_shards, true as sized, true as dated from {PLACED} where model_slug = 'beta-7b' group by 1, 2",
    "download_files": f"""with f as (select distinct model_slug, tier, {SHARD.format('record_id')} as shard from {PLACED}) select 'first' as step, count(*) as downloaded, 0::bigint as skipped, 0::bigint as failed, (select count(*) from (select distinct model_slug, tier, record_id from {PLACED})) as records, true as copied from f
  union all select 'again', 0, count(*), 0, 0, false from f where model_slug = 'beta-7b'""",
    "published_catalog": f"""with p as (select * from {PLACED} where conv_id % 13 > 0 and conv_id % 7 between 1 and 5 and conv_id % 11 > 0), d as (select distinct model_slug, record_id from p)
  select model_slug, count(*) as model_records, any_value((select arg_min(model, {SHARD.format('q.record_id')} || q.record_id) from p q where q.model_slug = d.model_slug)) as display_name, (select count(*) from d) as total_records, (select count(*) + 1 from {CANON} where conv_id % 7 = 0) as deletions_count from d group by 1""",
    "deleted_from_files": f"with p as (select distinct record_id, model_slug, conv_id from {PLACED}) select distinct record_id, model_slug from p where record_id not in (select record_id from p where conv_id % 5 = 0)",
    "typed_lines": f"""with r as (select doc_id, {_pick(adapters.RAW_NUMBERS, 'doc_id')} as a, {_pick(adapters.RAW_NUMBERS, 'doc_id * 3 + 1')} as b from documents)
  select doc_id, case when a not in ('"x"', '5.5', 'null') then 5 end::int as turn_count, case when b not in ('"x"', '5.5', 'null') then 5 end::int as user_rating,
  array_to_string(list_filter([case when a in ('"x"', '5.5') then 'type:trajectory.turn_count' end, case when b in ('"x"', '5.5') then 'type:outcome.user_rating' end, case when b in ('"x"', '5.5', 'null') then 'user_rating' end], lambda x: x is not null), ',') as errors from r""",
    "store_records": f"select coalesce(min(doc_id) filter (doc_id % 2 = 0), min(doc_id)) as doc_id, model_slug, tier, record_id from {DATASET} group by 2, 3, 4",
    "store_records_of_tier": f"select coalesce(min(doc_id) filter (doc_id % 2 = 0), min(doc_id)) as doc_id, record_id from {DATASET} where model_slug = 'src1' and tier = 'gold' group by 2",
    "store_tiers": f"""select model_slug, tier, count(*) as record_count, coalesce((2 * sum(round(score * 10000)::bigint) + count(score))::bigint // (2 * count(score)) / 10000.0::double, 0.0) as avg_quality_score, array_to_string(list_sort(list_distinct(list(shard))), ',') as shards from {STORED} group by 1, 2""",
    "store_models": f"""with d as (select * from {STORED}), gpus as (select model_slug, string_agg(gpu_name || '=' || n::varchar, ',' order by gpu_name) as hardware from (select model_slug, gpu_name, count(*) as n from d where gpu_name is not null group by 1, 2) group by 1)
  select model_slug, count(*) as total_records, model_slug as display_name, array_to_string(list_sort(list_distinct(list(lang))), ',') as langs, any_value(hardware) as hardware from d left join gpus using (model_slug) group by 1""",
    "store_active": f"with d as (select * from {STORED}) select model_slug, count(*) as n, (select count(*) from {DATASET} where tier = 'review_needed') as deletions from d where record_id not in (select record_id from {DATASET} where tier = 'review_needed') group by 1",
    "activity_consumed": "select case when event_id % 3 = 0 then 0 else 1 end::int as step, event_type as action, count(*) as n from events group by 1, 2",
} | {f"consent_strip_{level}": _consent(level) for level in fixed.CONSENT_LEVELS}
