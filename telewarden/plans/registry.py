"""Named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the SQL that must give the same rows."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


# The input views as SQL.
VIEWS: dict[str, str] = {
    "v_telemetry": """select event_id, ts, concat('node-', cast(user_id % 8 as varchar)) as node_name,
        concat('user-', cast(user_id as varchar)) as user_name, event_type as action, value as cpu_usage,
        cast(regexp_extract(props, '([0-9]+)', 1) as double) as memory_usage, cast(event_id % 200 as int) as process_count
        from events""",
    "v_dirty": """select event_id, ts, concat('node-', cast(user_id % 8 as varchar)) as node_name,
        case when event_id % 17 = 0 then null else value end as x1,
        case when event_id % 11 < 2 then null else cast(regexp_extract(props, '([0-9]+)', 1) as double) end as x2,
        cast(event_id % 200 as double) as x3, cast(5 as double) as x4 from events""",
    "v_audit": """select event_id, ts,
        case user_id % 6 when 0 then 'admin' when 1 then 'developer' when 2 then 'system:apiserver'
            when 3 then 'system:kubelet' when 4 then 'suspicious_user' else 'unknown_user' end as user_name,
        case event_id % 11 when 0 then 'get' when 1 then 'list' when 2 then 'create' when 3 then 'update' when 4 then 'patch'
            when 5 then 'delete' when 6 then 'watch' when 7 then 'exec' when 8 then 'port-forward' when 9 then 'logs' else 'describe' end as action,
        case user_id % 7 when 0 then 'pods' when 1 then 'deployments' when 2 then 'services' when 3 then 'configmaps'
            when 4 then 'secrets' when 5 then 'rbac' else 'secret' end as resource,
        case user_id % 3 when 0 then 'default' when 1 then 'kube-system' else 'monitoring' end as namespace,
        case event_id % 5 when 0 then 200 when 1 then 201 when 2 then 401 when 3 then 403 else null end as status_code,
        case when event_id % 10 = 0 then null else cast(floor(value * 100) as int) end as response_time_ms,
        case when event_id % 13 = 0 then null else cast(event_id % 3000 as int) end as object_count,
        case when event_type = 'error' then cast(user_id % 21 as int) end as failed_attempts,
        event_type = 'signup' as bulk_delete, event_type = 'error' as is_anomaly from events""",
    "v_scored": """select event_id, ts, concat('node-', cast(user_id % 8 as varchar)) as node_name,
        least(value / 100, cast(1 as double)) as s_lstm,
        cast(regexp_extract(props, '([0-9]+)', 1) as double) / 100 as s_if,
        cast(event_id % 101 as double) / 100 as s_gnn,
        case when event_type = 'error' then 1 else 0 end as y_true from events""",
    "v_fused": """select *, least(greatest(0.47e0 * s_lstm + 0.28e0 * s_if + 0.25e0 * s_gnn, 0e0), 1e0) as score,
        1e0 - (greatest(s_lstm, s_if, s_gnn) - least(s_lstm, s_if, s_gnn)) as confidence from v_scored""",
    "v_policy": """select f.*, a.user_name, a.action, a.namespace,
        case when a.user_name in ('admin', 'developer') then a.user_name else 'system' end as user_role
        from v_fused f join v_audit a using (event_id)""",
    "v_gappy_scored": """select event_id, ts, node_name, case when event_id % 9 <> 4 then s_lstm end as s_lstm,
        case when event_id % 7 <> 3 then s_if end as s_if, s_gnn, y_true from v_scored""",
    "v_gappy_fused": """select *, 0.47e0 * s_lstm + 0.28e0 * s_if + 0.25e0 * s_gnn as raw, case when s_lstm is not null and s_if is not null
        then least(greatest(0.47e0 * s_lstm + 0.28e0 * s_if + 0.25e0 * s_gnn, 0e0), 1e0) end as score,
        least(greatest((0.47e0 * coalesce(s_lstm, 0) + 0.28e0 * coalesce(s_if, 0) + 0.25e0 * s_gnn)
        / (0.25e0 + case when s_lstm is null then 0e0 else 0.47e0 end + case when s_if is null then 0e0 else 0.28e0 end), 0e0), 1e0) as weighted
        from v_gappy_scored""",
    "v_nodes": """select concat('node-', cast(user_id % 8 as varchar)) as graph_id, user_id as node_id, avg(value) as f0,
        avg(cast(regexp_extract(props, '([0-9]+)', 1) as double)) as f1, avg(cast(event_id % 200 as double)) as f2
        from events group by user_id""",
    "v_edges": """select graph_id, src, dst, sum(value) as traffic, count(*) as n_events
        from (select concat('node-', cast(user_id % 8 as varchar)) as graph_id, user_id as dst, value,
              lag(user_id) over (partition by user_id % 8 order by ts, event_id) as src from events) t
        where src is not null group by graph_id, src, dst""",
    "v_logs": """select event_id, ts, case event_id % 3 when 0 then 'kube.audit' when 1 then 'kubelet'
        else concat('container.', event_type) end as tag, props as log from events""",
    "v_pods": """select concat('node-', cast(i as varchar)) as node_name, r_name
        from (select unnest(range(0, 7)) as i) n join region on r_regionkey = i % 5""",
    "v_codes": """select *,
        list_reduce(list_prepend(0::bigint, [unicode(c)::bigint for c in string_split(action, '')]), lambda a, x: (a * 31 + x) % 4294967296) as ah,
        list_reduce(list_prepend(0::bigint, [unicode(c)::bigint for c in string_split(user_name, '')]), lambda a, x: (a * 31 + x) % 4294967296) as uh
        from v_telemetry""",
    "v_features": """select event_id, ts, node_name, cpu_usage as f0, memory_usage as f1, cast(process_count as double) as f2,
        cpu_usage * memory_usage as f3, cpu_usage / (process_count + 1) as f4, memory_usage / (process_count + 1) as f5,
        cast(abs(case when ah >= 2147483648 then ah - 4294967296 else ah end) % 20 as double) as f6,
        cast(abs(case when uh >= 2147483648 then uh - 4294967296 else uh end) % 50 as double) as f7 from v_codes""",
}

_NEEDS = {
    "v_fused": ["v_scored"],
    "v_policy": ["v_scored", "v_fused", "v_audit"],
    "v_gappy_scored": ["v_scored"],
    "v_gappy_fused": ["v_scored", "v_gappy_scored"],
    "v_codes": ["v_telemetry"],
    "v_features": ["v_telemetry", "v_codes"],
}


def over(views: str, body: str, **ctes: str) -> str:
    """``body`` with the named views, and then further CTEs, in front."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    parts = [f"{n} as ({VIEWS[n]})" for n in names] + [f"{n} as ({sql})" for n, sql in ctes.items()]
    return f"with {', '.join(parts)} {body}"


def grid_sql(x: str, digits: int) -> str:
    """SQL for ``grid``."""
    return f"floor(({x}) * 1e{digits} + {_SHIFT}e0) / 1e{digits}"


# Engines break rounding ties differently; an off-centre border leaves no decimal value on it.
_SHIFT = 0.27182818


def grid(x: Column, digits: int) -> Column:
    """``x`` snapped to a decimal grid, for comparing sums taken in different orders."""
    return F.floor(x * F.lit(float(10**digits)) + F.lit(_SHIFT)).cast("double") / F.lit(float(10**digits))
