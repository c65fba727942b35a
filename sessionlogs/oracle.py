"""The registered queries as plain SQL over the given tables, for checking results."""

from __future__ import annotations

_DETAIL = """when 0 then 'Database cluster unavailable - all nodes down' when 1 then 'Gateway timeout'
    when 2 then 'Data validation failed - missing required fields' when 3 then 'Authentication token expired'
    when 4 then 'Rate limit exceeded' when 5 then 'Connection pool exhausted'
    when 6 then 'Insufficient permissions' when 7 then 'Unexpected business rule'"""
_CODE = "when 0 then 500 when 1 then 422 when 2 then 401 when 3 then 403 when 4 then 400"


def _call_id(n: str) -> str:
    return (
        f"case when {n} <= 1 then 'urc-root-' || sid "
        f"when {n} % 13 = 0 then 'urc-evt-req-db-' || sid || '-' || cast({n} as varchar) "
        f"else 'urc-evt-req-' || sid || '-' || cast({n} as varchar) end"
    )


def _value(key: str) -> str:
    return rf"nullif(regexp_extract(message, '{key}=([^,\s]+)', 1), '')"


def _in_call_id(column: str) -> str:
    return f"nullif(regexp_extract({column}, 'urc-[^-]+-[^-]+-([a-z0-9]+)-\\d+', 1), '')"


# --- fixed values: phrases and words that decide the results, written out here so that they are checked too ---
_SEVERITY = """case when regexp_matches(lower(message), 'database cluster unavailable|all nodes down|data corruption detected'
    '|emergency fallback failed|backup systems offline|critical database error|system failure|catastrophic|total system'
    '|complete failure|service unavailable|cluster down|infrastructure failure') then 'CRITICAL'
    when regexp_matches(lower(message), 'connection pool exhausted|database deadlock detected|gateway timeout'
    '|upstream service unavailable|authentication failed|database authentication failed|status_code=50|status_code=503'
    '|status_code=504|status_code=401|timeout|deadlock|constraint violation|transaction rollback|resource locked'
    '|maintenance mode') then 'HIGH'
    when regexp_matches(lower(message), 'status_code=422|validation failed|missing required fields|internal server error'
    '|status_code=400|bad request') then 'MEDIUM' else 'LOW' end"""
_ERROR_LEVEL = "upper(level) in ('ERROR', 'WARN')"
_IS_ERROR = f"({_ERROR_LEVEL} or regexp_matches(lower(message), 'error|failed'))"
_ERROR_TYPE = f"""case when not {_IS_ERROR} then null when contains(lower(message), 'timeout') then 'timeout'
    when contains(lower(message), 'rate limit') then 'rate_limit' when contains(lower(message), 'authentication') then 'authentication'
    when contains(lower(message), 'connection') then 'connection' when contains(lower(message), 'validation') then 'validation'
    when contains(lower(message), 'business') then 'business' when {_ERROR_LEVEL} then 'system' else 'unknown_error' end"""
_FALLBACK = """case when contains(lower(message), 'timeout') then 'timeout'
    when regexp_matches(lower(message), 'auth|credentials') then 'authentication'
    when contains(lower(message), 'rate limit') then 'rate_limit' when contains(lower(message), 'connection') then 'connection'
    when contains(lower(message), 'queue') then 'queue'
    when regexp_matches(lower(message), 'performance|latency') then 'performance' else 'unknown' end"""
# --- end of fixed values ---
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"

# Each step is a CTE; a query uses the steps up to the one it reads.
_STEPS = {
    "b": """select user_id, event_type, value, ts,
        row_number() over (partition by user_id order by ts, event_id) as n,
        'u' || lpad(cast(user_id as varchar), 6, '0') as sid from events""",
    "c": f"""select *, cast(floor(n / 2) as bigint) as pn,
        case when user_id % 5 = 3 then 'INFO' when event_type = 'error' then 'ERROR'
             when event_type = 'signup' and n % 5 = 0 then 'WARN' else 'INFO' end as lvl,
        case when user_id % 5 = 4 then 'Data validation failed - missing required fields' else case n % 8 {_DETAIL} end end as det,
        case when event_type = 'error' and user_id % 5 = 4 then 422 when event_type = 'error' then case n % 5 {_CODE} end else 200 end as code,
        case when n % 29 = 0 and user_id % 11 = 5 then 'no time'
             else substr(cast(case when n % 11 = 0 and n > 1 then ts + interval 10 day else ts end as varchar), 1, 19) end as rt
        from b""",
    "d": f"select *, {_call_id('n')} as urc, {_call_id('pn')} as uid from c",
    "lines": """select user_id * 10000000000 + n * 10 as line_no,
        '[' || rt || '] [INFO] api_gateway: User ''user_' || cast(user_id as varchar) || ''' logged in session_id='
        || sid || ' cif_id=' || cast(user_id + 100000 as varchar) || ' URC=' || urc as value from d where n = 1 and user_id % 11 <> 5
        union all
        select user_id * 10000000000 + n * 10 + s.seq, '[' || rt || '] [INFO] svc_' || event_type
        || ': Request received for /api/v1/' || event_type || ', URC=' || urc || ', UID=' || uid
        || ', transaction_type=' || event_type from d, (values (1), (4)) s(seq)
        where n > 1 and (s.seq = 1 or n % 17 = 0)
        union all
        select user_id * 10000000000 + n * 10 + 2, '[' || rt || '] [' || lvl || '] svc_' || event_type
        || ': Response sent for /api/v1/' || event_type || ', URC=' || urc || ', UID=' || uid || ', status_code='
        || cast(code as varchar) || ', duration: ' || cast(cast(floor(value) as bigint) as varchar)
        || case when lvl = 'INFO' then '' else ', error_details=' || det end from d where n > 1
        union all
        select user_id * 10000000000 + n * 10 + 3, '[' || rt || '] [ERROR] svc_' || event_type || ': Downstream failed, '
        || case when n % 2 = 0 then 'URC=' || urc || ', ' else '' end || 'UID=' || uid || ', endpoint=/api/v1/'
        || event_type || ', reason=' || det from d where n > 1 and n % 7 = 0 and user_id % 5 <> 3
        union all
        select user_id * 10000000000 + n * 10 + 5, 'malformed line without brackets ' || cast(n as varchar)
        from d where n % 23 = 0""",
    "parts": r"""select line_no, g.ts_raw as ts_raw, g.level as level, g.service as service, g.message as message from (
        select line_no, regexp_extract(value, '^\[(.*?)\] \[(.*?)\] (.*?): (.*)',
            ['ts_raw', 'level', 'service', 'message']) as g
        from lines where regexp_matches(value, '^\[(.*?)\] \[(.*?)\] (.*?): (.*)'))""",
    "fields": f"""select *, try_strptime(ts_raw, '%Y-%m-%d %H:%M:%S') as ts,
        contains(lower(message), 'logged in') as is_login,
        contains(lower(message), 'request received') as is_request,
        not contains(lower(message), 'request received') and contains(lower(message), 'response sent') as is_response,
        {_value('session_id')} as explicit_id, {_value('URC')} as urc, {_value('UID')} as uid,
        {_value('cif_id')} as cif_id, {_value('transaction_type')} as transaction_type,
        {_value('endpoint')} as api_endpoint, {_ERROR_TYPE} as error_type,
        case upper(level) when 'ERROR' then 'HIGH' when 'WARN' then 'MEDIUM' end as severity,
        try_cast(nullif(regexp_extract(message, '(?i)duration[:\\s]+(\\d+)', 1), '') as bigint) as duration_ms
        from parts""",
    "recs": f"""select *, coalesce(explicit_id, {_in_call_id('urc')}, {_in_call_id('uid')}) as session_id from fields""",
    "copies": """select *, row_number() over (partition by session_id, ts, message, service order by line_no) as rn
        from recs where session_id is not null""",
    "pos": """select *, row_number() over (partition by session_id order by ts nulls first, line_no) as p
        from copies where rn = 1""",
    "roots": """select session_id, arg_min(urc, p) as root_urc from pos
        where is_login and urc is not null group by session_id""",
    "tree": """select session_id, root_urc as urc, cast(null as varchar) as parent_urc, 0 as level, cast(0 as bigint) as att
        from roots
        union all
        select r.session_id, r.urc, r.uid, t.level + 1, r.p from tree t join pos r
        on r.session_id = t.session_id and r.uid = t.urc and r.p > t.att
        where r.is_request and r.urc is not null and t.level < 4""",
    "nodes": """select session_id, urc, arg_min(parent_urc, att) filter (where att > 0) as parent_urc,
        arg_min(level, att) as level, min(att) as att from tree group by session_id, urc""",
    "resp": """select n.session_id, n.urc as node_urc, n.att, max(r.p) as p from nodes n join pos r
        on r.session_id = n.session_id and r.uid = n.urc and r.p > n.att where r.is_response
        group by n.session_id, n.urc, n.att""",
    "errs": """select e.session_id, e.p, n.urc as node_urc, n.att from pos e join nodes n
        on n.session_id = e.session_id and n.urc = coalesce(e.urc, e.uid) and e.p > n.att
        where e.error_type is not null and not (e.is_request and e.urc is not null)
        and not (e.is_response and exists (select 1 from nodes m
            where m.session_id = e.session_id and m.urc = e.uid and e.p > m.att))""",
    "pool": f"""select x.*, r.ts, r.level, r.service, r.message, coalesce(r.error_type, 'unknown') as error_type,
        r.urc, r.uid, {_ERROR_LEVEL} as in_chain, {_SEVERITY} as sev,
        row_number() over (partition by x.session_id order by x.att, x.is_node_response, x.p) as pool_no
        from (select session_id, node_urc, att, p, 0 as is_node_response from errs
              union all
              select s.session_id, s.node_urc, s.att, s.p, 1 from resp s join pos q
              on q.session_id = s.session_id and q.p = s.p where upper(q.level) in ('ERROR', 'WARN')) x
        join pos r on r.session_id = x.session_id and r.p = x.p""",
    "chain": """select *, row_number() over (partition by session_id order by pool_no) as e from pool where in_chain""",
    "heads": """select session_id, count(*) filter (where in_chain) as total_errors,
        count(*) filter (where in_chain and sev = 'CRITICAL') as critical,
        count(*) filter (where in_chain and sev = 'HIGH') as high,
        count(*) filter (where in_chain and sev = 'MEDIUM') as medium,
        count(*) filter (where in_chain and sev = 'LOW') as low,
        case max(case when not in_chain then 0 else case sev when 'CRITICAL' then 3 when 'HIGH' then 2
            when 'MEDIUM' then 1 else 0 end end)
            when 3 then 'CRITICAL' when 2 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as impact_level
        from pool group by session_id""",
    "trig": "select * from chain where e = 1",
    "found": """select t.*, coalesce(r.root_urc, 'unknown') as root_urc,
        coalesce(h.impact_level, 'UNKNOWN') as chain_impact, h.total_errors
        from trig t left join roots r using (session_id) left join heads h on h.session_id = t.session_id
        and exists (select 1 from chain c where c.session_id = t.session_id
            and (c.message = t.message or c.ts = t.ts))""",
    "calls": """select *, row_number() over (partition by session_id order by att) as call_no from nodes""",
    "kids": """select session_id, parent_urc as urc, urc as child, att,
        row_number() over (partition by session_id, parent_urc order by att) as k
        from nodes where parent_urc is not null""",
}
_ORDER = list(_STEPS)


def _sql(upto: str, select: str) -> str:
    used = _ORDER[: _ORDER.index(upto) + 1]
    ctes = ",\n".join(f"{name} as ({_STEPS[name]})" for name in used)
    return f"with recursive {ctes}\n{select}"


def _recs(columns: str, where: str = "") -> str:
    return _sql("recs", f"select {columns} from recs {where}")


_TS = _ISO.format("ts") + " as ts"
_FLAT = (
    f"line_no, {_TS}, level, service, message, is_login, is_request, is_response, session_id, urc, uid, "
    "cif_id, transaction_type, api_endpoint, error_type, severity, duration_ms"
)
_RANGE = "ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 12:00:00'"
_ERROR_COLUMNS = (
    _ISO.format("ts") + ' as "timestamp", level, service as source, message, error_type, urc, uid, '
    "sev as calculated_severity"
)

# Mean embedding per label, and the cosine of every embedding to it.
_CENTROIDS = """with parts as (
    select label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from embeddings),
means as (select label, i, avg(x) as m from parts group by label, i),
vec as (select label, list(m order by i) as q from means group by label),
scored as (select cast(label as bigint) as query_id, vec_id,
    round(list_cosine_similarity(cast(embedding as double[]), q), 6) as score from embeddings, vec
    where embeddings.label is not null and vec.q is not null),
""".replace("select cast(label as bigint)", "select cast(vec.label as bigint)")
_TOP = _CENTROIDS + """top as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank
    from scored)
"""

_REPLIES = """with r as (select event_id, event_type, user_id, event_id % 4 as kind,
    'event ' || event_type || ' ' || json_extract_string(props, '$.k') as msg from events),
body as (select *, case when kind = 3 then '"' || msg || '"' when event_id % 9 = 0 then '[]'
        else '["' || msg || '"]' end as messages,
    '{"problem_description": "' || event_type || '", "probable_root_cause_summary": "k", "key_error_log_messages": '
    || case when kind = 3 then '"' || msg || '"' when event_id % 9 = 0 then '[]' else '["' || msg || '"]' end
    || ', "confidence_score": 0.5, "associated_identifiers": {"session_id": "u'
    || lpad(cast(user_id as varchar), 6, '0') || '"}}' as full_body from r),
replies as (select *, case kind when 1 then '```json' || chr(10) || full_body || chr(10) || '```'
    when 2 then substr(full_body, 1, 40) else full_body end as reply from body),
plain as (select *, case when reply like '```%' and reply like '%```'
    then regexp_replace(regexp_replace(reply, '^```[^\\n]*\\n', ''), '\\n```$', '') else reply end as body_text from replies)
"""

_NL = " || chr(10) || "


def _line(label: str, value: str) -> str:
    return f"'- {label}: ' || {value}"


def _json(pad: int, name: str, value: str, last: bool = False) -> str:
    """A text member of pretty-printed JSON."""
    end = "" if last else ","
    quoted = f"coalesce('\"' || {value} || '\"', 'null')"
    return f"'{' ' * pad}\"{name}\" : ' || {quoted} || '{end}'"


_ERROR_JSON = _NL.join(
    ["'{'", _json(4, "timestamp", _ISO.format("c.ts")), _json(4, "level", "c.level")]
    + [_json(4, "source", "c.service"), _json(4, "message", "c.message")]
    + [_json(4, n, f"c.{n}") for n in ("error_type", "urc", "uid")]
    + [_json(4, "calculated_severity", "c.sev", last=True), "'  }'"]
)
_CHAIN_JSON = _NL.join(
    ["'{'", _json(2, "session_id", "t.session_id"), """'  "errors" : [ ' || l.errors || ' ],'"""]
    + ["""'  "total_errors" : ' || h.total_errors || ','""", _json(2, "impact_level", "h.impact_level")]
    + ["""'  "severity_breakdown" : {'"""]
    + [f"""'    "{n}" : ' || h.{n} || ','""" for n in ("critical", "high", "medium")]
    + ["""'    "low" : ' || h.low""", "'  }'", "'}'"]
)
_RCA_TEXT = _NL.join(
    [_line("Session ID", "t.session_id"), _line("URC", "coalesce(t.urc, 'N/A')")]
    + [_line("UID", "coalesce(t.uid, 'N/A')"), _line("Service", "t.service")]
    + [_line("Error type", "t.error_type"), _line("Message", "t.message"), _line("Severity", "t.sev")]
    + ["'- API endpoint: N/A'", "'- Transaction type: N/A'", "'Error chain:'", _CHAIN_JSON]
    + ["'Documentation:'", "''"]
)
_ADVICE_TEXT = _NL.join(
    ["'Analysis:'", "'{'", _json(2, "problem_description", "a.event_type")]
    + [_json(2, "probable_root_cause_summary", "'k'")]
    + ["""'  "key_error_log_messages" : [ "' || a.msg || '" ],'""", """'  "confidence_score" : 0.5,'"""]
    + ["""'  "associated_identifiers" : {'""", _json(4, "session_id", "a.session_id")]
    + [f"""'    "{n}" : null,'""" for n in ("urc", "uid", "service_name", "api_endpoint")]
    + ["""'    "transaction_type" : null'""", "'  }'", "'}'"]
    + [_line("Message", "t.message"), _line("Error type", "t.error_type")]
    + [_line("Session ID", "t.session_id"), _line("Service", "t.service"), "'Documentation:'", "''"]
)



def _documented(text: str, label: int) -> str:
    """The text with documentation behind its last line."""
    found = f"select string_agg(d.text, ' ' order by rank) from top join documents d on d.doc_id = vec_id where rank <= 5 and query_id = {label}"
    return text.removesuffix("''") + f"coalesce(({_TOP} {found}), '')"


def _rca_pack(text: str) -> str:
    return _sql(
        "trig",
        f"""select t.session_id, {text} as context from trig t
        join heads h on h.session_id = t.session_id
        join (select c.session_id, string_agg({_ERROR_JSON}, ', ' order by c.e) as errors from chain c group by 1) l
        on l.session_id = t.session_id""",
    )


def _advice_pack(text: str) -> str:
    return _sql(
        "trig",
        f"""select t.session_id, {text} as context from trig t join (
            select 'u' || lpad(cast(user_id as varchar), 6, '0') as session_id, event_type,
            'event ' || event_type || ' ' || json_extract_string(props, '$.k') as msg from events
            where event_id % 4 <> 2 and (event_id % 4 = 3 or event_id % 9 <> 0)) a
        on a.session_id = t.session_id""",
    )


ORACLES: dict[str, str] = {
    "scan_log_text": _recs(f"{_TS}, level, service, message"),
    "service_from_path": "select page_id, regexp_extract(url, '([^/.]*)[^/]*$', 1) as service from pages",
    "scan_indexed_docs": _recs(f"line_no, session_id, {_TS}, level, service, message", f"where {_RANGE}"),
    "scan_stored_fields": _recs("line_no, urc, error_type, duration_ms", f"where {_RANGE}"),
    "sink_structured_docs": _recs(
        "cast(cast(ts as date) as varchar) as event_date, count(*) as n_docs, count(session_id) as n_with_session",
        "group by 1",
    ),
    "sink_full_analysis": _sql(
        "heads",
        """select r.session_id, r.root_urc, n.total_calls, n.total_calls as n_calls, n.total_calls - 1 as n_children,
        h.impact_level, coalesce(h.total_errors, 0) as n_errors, case when h.total_errors is not null then
        sha256(coalesce(c.messages, '')) end as messages_sha256 from roots r
        join (select session_id, count(*) as total_calls from nodes group by session_id) n using (session_id)
        left join heads h using (session_id)
        left join (select session_id, string_agg(message, chr(10) order by e) as messages from chain group by 1) c
        using (session_id)""",
    ),
    "sink_root_causes": _sql(
        "found",
        """select session_id, message as triggering_error_message, chain_impact as overall_chain_impact,
        total_errors, total_errors as n_errors from found""",
    ),
    "scan_documents": "select doc_id as source, length(text) as text_length from documents",
    "parse_log_line": _sql("parts", "select line_no, ts_raw, level, service, message from parts"),
    "parse_timestamp": _recs(f"line_no, {_TS}, ts is null as ts_invalid"),
    "extract_session_id": _recs("line_no, explicit_id as session_id"),
    "extract_urc": _recs("line_no, urc"),
    "extract_uid": _recs("line_no, uid"),
    "infer_session_id": _recs("line_no, session_id"),
    "extract_cif_id": _recs("line_no, cif_id"),
    "extract_transaction_type": _recs("line_no, transaction_type"),
    "extract_api_endpoint": _recs("line_no, api_endpoint"),
    "event_kind": _recs("line_no, is_login, is_request, is_response"),
    "is_error": _recs(f"line_no, {_IS_ERROR} as is_error"),
    "error_type": _recs("line_no, error_type"),
    "level_severity": _recs("line_no, severity"),
    "extract_duration": _recs("line_no, duration_ms"),
    "content_severity": _recs(f"line_no, {_SEVERITY} as calculated_severity"),
    "flatten_record": _recs(_FLAT),
    "reparse_on_read": _recs("line_no, session_id, urc, uid, error_type, duration_ms"),
    "fallback_error_type": _recs(f"line_no, {_FALLBACK} as error_type"),
    "route_by_content": _sql(
        "lines",
        """select line_no, case when regexp_matches(value, 'api_gateway|3scale') then 'gateway'
        when regexp_matches(value, 'payment|order') then 'payment' else 'tibco' end as route
        from lines""",
    ),
    "timestamp_default": _recs(
        "line_no, " + _ISO.format("coalesce(ts, timestamp '1970-01-01 00:00:00')") + " as order_ts"
    ),
    "require_session": _recs("line_no, session_id", "where session_id is not null"),
    "time_range": _recs(
        f"line_no, {_TS}, message",
        "where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-05 00:02:00'",
    ),
    "filter_logs_by_time": _recs("service, count(*) as n_records", f"where {_RANGE} group by service"),
    "error_levels_only": _recs("line_no, level", f"where {_ERROR_LEVEL}"),
    "skip_empty_chains": _sql("heads", "select session_id, total_errors from heads where total_errors > 0"),
    "session_has_errors": _sql("pool", "select distinct session_id from pool where in_chain"),
    "drop_uncorrelated": _sql(
        "roots",
        """select session_id, count(*) as rows_after from pos
        where session_id in (select session_id from roots) group by session_id""",
    ),
    "dedup_session_logs": _sql("pos", f"select session_id, line_no, {_TS}, level, service, message from pos"),
    "dedup_counts": _sql(
        "copies",
        """select session_id, count(*) as rows_before, count(*) filter (where rn = 1) as rows_after
        from copies group by session_id""",
    ),
    "session_root": _sql("roots", "select session_id, root_urc from roots"),
    "build_call_tree": _sql("nodes", "select session_id, urc, parent_urc, level from nodes"),
    "orphan_requests": _sql(
        "nodes",
        """select session_id, urc, count(*) as n_requests from pos p where is_request and urc is not null
        and not exists (select 1 from nodes n where n.session_id = p.session_id and n.urc = p.urc)
        group by session_id, urc""",
    ),
    "attach_responses": _sql(
        "resp",
        """select r.session_id, r.node_urc, p.urc as response_urc, p.level, p.message
        from resp r join pos p on p.session_id = r.session_id and p.p = r.p""",
    ),
    "attach_errors": _sql(
        "errs",
        """select r.session_id, r.node_urc, p.level, p.message, p.error_type
        from errs r join pos p on p.session_id = r.session_id and p.p = r.p""",
    ),
    "chain_context_lookup": _sql("found", "select session_id, message, chain_impact, total_errors from found"),
    "root_urc_lookup": _sql("found", "select session_id, root_urc from found"),
    "merge_sources": _recs(
        "session_id, b as source_bucket, count(*) as n_records",
        ", (values ('index'), ('events')) s(b) where session_id is not null group by 1, 2",
    ),
    "union_sources": _recs(
        "session_id, b as source_bucket, line_no, level",
        ", (values ('index'), ('events')) s(b) where session_id is not null",
    ),
    "group_by_session": _recs(
        "session_id, 'index' as source_bucket, count(*) as n_records",
        "where session_id is not null group by 1",
    ),
    "session_count": _recs("count(distinct session_id) as n_sessions"),
    "log_content": _sql(
        "pos",
        """select session_id, 'index' as source_bucket, cast(0 as bigint) as segment_no,
        string_agg(message, chr(10) order by p) as content from pos group by 1, 2""",
    ),
    "children_list": _sql(
        "kids",
        """select session_id, urc, count(*) as n_items, string_agg(child, ',' order by k) as children
        from kids group by 1, 2""",
    ),
    "api_calls": _sql("calls", "select session_id, call_no, urc, parent_urc, level from calls"),
    "api_calls_nested": _sql(
        "kids",
        """select c.session_id, cast(call_no - 1 as bigint) as call_idx, c.urc, c.level, coalesce(l.children, '') as children
        from calls c left join (select session_id, urc, string_agg(child, ',' order by k) as children
            from kids group by 1, 2) l on l.session_id = c.session_id and l.urc = c.urc""",
    ),
    "total_calls": _sql("nodes", "select session_id, count(*) as total_calls from nodes group by session_id"),
    "session_error_pool": _sql(
        "pool", "select session_id, pool_no, node_urc, is_node_response, level, message from pool"
    ),
    "error_chain": _sql(
        "chain",
        f"select session_id, cast(e - 1 as bigint) as error_idx, {_ERROR_COLUMNS} from chain",
    ),
    "severity_breakdown": _sql("heads", "select session_id, total_errors, critical, high, medium, low from heads"),
    "impact_level": _sql("heads", "select session_id, impact_level from heads"),
    "trigger_error": _sql("trig", f"select session_id, {_ERROR_COLUMNS} from trig"),
    "correlation_record": _sql(
        "heads",
        """select r.session_id, r.root_urc, n.total_calls, h.total_errors, h.critical, h.high, h.medium, h.low,
        h.impact_level from roots r
        join (select session_id, count(*) as total_calls from nodes group by session_id) n using (session_id)
        left join heads h using (session_id)""",
    ),
    "distinct_error_queries": _sql(
        "pool", f"""select distinct 'error pattern ' || case when error_type <> 'unknown' then error_type
        else {_FALLBACK} end as query from pool where in_chain""",
    ),
    "sort_by_time": _recs(f"line_no, {_TS}, message"),
    "limit_earliest": _sql(
        "recs", f"select line_no, {_TS} from (select * from recs order by ts nulls first, line_no limit 10000)"
    ),
    "normalise_pages": """with p as (select *, row_number() over (partition by conv_id order by turn) as k
        from conversations) select conv_id, cast(0 as bigint) as segment_no,
        string_agg(text, chr(10) order by k) || chr(10) as text from p group by 1""",
    "chunk_fixed": """with n as (select doc_id, text,
        greatest(cast(ceil((length(text) - 200) / 800.0) as bigint), 1) as total from documents where length(text) > 0)
        select doc_id as source, i as chunk, total as total_chunks, substr(text, i * 800 + 1, 1000) as content
        from (select *, unnest(range(total)) as i from n)""",
    "replace_session_docs": """select 's' || cast(doc_id % 10 as varchar) as session_id,
        cast(sum(greatest(cast(ceil((length(text) - 200) / 800.0) as bigint), 1)) as bigint) as n_chunks,
        count(*) as n_docs from documents where length(text) > 0 group by 1""",
    "topk_similar": _TOP + "select query_id, rank, vec_id, score from top where rank <= 5",
    "relevant_context": _TOP + """select query_id, string_agg(d.text, ' ' order by rank) as context
        from top join documents d on d.doc_id = vec_id where rank <= 5 group by query_id""",
    "documentation_context_vectors": _TOP + """select query_id, case when query_id < 3 then 'recommendations'
        when query_id < 6 then 'best_practices' else 'error_patterns' end as section, rank, vec_id, score
        from top where rank <= 3""",
    "root_cause_record": _sql(
        "found",
        f"""select {_ISO.format('ts')} as "timestamp", message as triggering_error_message,
        error_type as triggering_error_type, service as source_service_from_log, session_id,
        root_urc as root_urc_of_session, urc as error_specific_urc, uid as error_specific_uid,
        cast(null as varchar) as error_specific_api_endpoint,
        cast(null as varchar) as error_specific_transaction_type, chain_impact as overall_chain_impact from found""",
    ),
    "rca_context_pack": _rca_pack(_RCA_TEXT),
    "recommendation_context_pack": _advice_pack(_ADVICE_TEXT),
    "rca_context_documented": _rca_pack(_documented(_RCA_TEXT, 0)),
    "recommendation_context_documented": _advice_pack(_documented(_ADVICE_TEXT, 1)),
    "strip_code_fence": _REPLIES + "select event_id, body_text as body from plain",
    "parse_model_json": _REPLIES + "select event_id, json_valid(body_text) as parsed_ok from plain",
    "validate_analysis": _REPLIES + """select event_id, messages <> '[]' as is_valid,
        case when messages = '[]' then 'key_error_log_messages' end as reason,
        case when messages <> '[]' then event_type end as problem_description,
        case when messages <> '[]' then msg end as messages,
        case when messages <> '[]' then 'u' || lpad(cast(user_id as varchar), 6, '0') end as session_id
        from plain where json_valid(body_text)""",
    "validate_recommendations": """select event_id, event_id % 9 in (5, 8) as is_valid,
        case event_id % 9 when 0 then 'recommendations[1].recommendation_type'
        when 1 then 'recommendations[1].recommendation_description' when 2 then 'recommendations[1].action_steps'
        when 3 then 'recommendations[1].relevant_documentation' when 4 then 'recommendations[1].applicable_to_identifiers'
        when 6 then 'recommendations' when 7 then 'json' end as reason,
        cast(case when event_id % 9 in (6, 7) then null else 2 end as integer) as n_items,
        case when event_id % 9 in (5, 8) then event_type end as description,
        case when event_id % 9 in (5, 8) then 'a,b' end as steps from events""",
    "impact_flags": _sql(
        "pool",
        """select session_id, bool_or(error_type = 'timeout') as performance_impact,
        bool_or(error_type in ('rate_limit', 'authentication')) as security_impact from pool group by session_id""",
    ),
    "affected_components": _recs(
        """line_no, '{"session":"' || session_id || '"' || coalesce(',"endpoint":"' || api_endpoint || '"', '')
        || coalesce(',"transaction":"' || transaction_type || '"', '') || '}' as affected_components""",
        "where session_id is not null",
    ),
    "explicit_severity": _recs(f"line_no, coalesce({_value('severity')}, severity) as severity"),
    "service_health": _recs(
        """service, round(avg(duration_ms), 6) as mean_duration_ms,
        round(avg(case when upper(level) in ('ERROR', 'WARN') then 1.0 else 0.0 end), 6) as error_rate,
        coalesce(round(avg(duration_ms), 6) >= 200, false)
        or round(avg(case when upper(level) in ('ERROR', 'WARN') then 1.0 else 0.0 end), 6) >= 0.01 as is_abnormal""",
        "group by service",
    ),
}
