"""Inputs that the given tables do not hold as such, derived row by row from them.

Each constant is a SELECT that Spark and an ANSI engine read alike, so the
oracle of a query starts from the same rows.
"""

# One source file per part.  Every fifth size is a JavaScript class component, the
# rest is Python whose branch count follows the size; some files do not parse.
CODE_FILES = """
SELECT p_brand AS project, k, n, js, broken,
       CASE WHEN js = 1 THEN concat('src/c', cast(k AS string), '.jsx')
            WHEN n % 10 = 1 THEN concat('tests/test_m', cast(k AS string), '.py')
            ELSE concat('src/m', cast(k AS string), '.py') END AS path,
       CASE WHEN js = 1 THEN '.jsx' ELSE '.py' END AS ext,
       CASE WHEN js = 1 THEN concat(
              'import React from ''react'';', chr(10),
              'import dep from ''lib', cast(dep AS string), ''';', chr(10),
              'class C', cast(k AS string), ' extends React.Component {', chr(10),
              '  componentDidMount() { fetch("/api/user/', cast(k AS string), '").then(r => r.json()); }', chr(10),
              '  render() {', chr(10), '    if (x) { this.setState({a: 1}); }', chr(10),
              '    return <p>{this.props.name}</p>;', chr(10), '  }', chr(10), '}', chr(10),
              CASE WHEN n % 3 = 0 THEN 'localStorage.setItem("pii", this.state.a);' ELSE 'export default 1;' END, chr(10))
            ELSE concat(
              '"Module ', cast(k AS string), '."', chr(10),
              'import m', cast(dep AS string), chr(10), 'import os', chr(10),
              CASE WHEN n % 4 = 0 THEN concat('DB = connect("postgres://svc:pw', cast(k AS string), '@db/main;password=x")', chr(10)) ELSE '' END,
              'class K', cast(k AS string), ':', chr(10), '    pass', chr(10),
              'def f', cast(k AS string), '(a, user):', chr(10),
              repeat(concat('    if a > 1 and user:', chr(10), '        a = a - 1', chr(10)), cast(n % 7 AS int)),
              CASE WHEN n % 3 = 0 THEN concat('    cur.execute("select 1")', chr(10)) ELSE '' END,
              CASE WHEN n % 9 = 2 THEN concat('    s = "{}".format(a) + xrange(3) / 2', chr(10)) ELSE '' END,
              '    return a', chr(10),
              CASE WHEN broken = 1 THEN concat('def broken(:', chr(10)) ELSE '' END) END AS content
FROM (SELECT p_brand, p_partkey AS k, p_size AS n, cast(floor(p_partkey / 2) AS bigint) AS dep,
             CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS js,
             CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END AS broken
      FROM {part}) base
"""

# Audit events from the event stream.
AUDIT_RAW = """
SELECT event_id AS source_id, ts, concat('tenant-', cast(user_id % 3 AS string)) AS tenant,
       CASE event_type WHEN 'error' THEN 'SECURITY_VIOLATION' WHEN 'signup' THEN 'MIGRATION_EVENT'
            ELSE 'FILE_ACCESS' END AS event_type,
       CASE WHEN user_id = 0 THEN '' ELSE concat('user-', cast(user_id AS string)) END AS user_name,
       CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'signup' THEN 'auth_login'
            WHEN 'purchase' THEN 'delete' ELSE 'violation' END AS action,
       CASE event_id % 6 WHEN 0 THEN concat('/srv/app/user/', cast(user_id AS string), '/profile.json')
            WHEN 1 THEN 'records/patient_list.csv' WHEN 2 THEN '/etc/service/api_key.txt'
            WHEN 3 THEN 'conf/config.yaml' WHEN 4 THEN '' ELSE concat('docs/page', cast(user_id AS string)) END AS resource,
       CASE WHEN value > 150 THEN 'failure' WHEN value > 120 THEN 'denied' ELSE 'success' END AS result,
       CASE WHEN value > 100 THEN 'CRITICAL' ELSE 'LOW' END AS severity,
       CASE WHEN event_id % 2 = 0 THEN '/home/dev/repo' ELSE 'repo' END AS project_path
FROM {events}
"""

# Rollout metrics: a deployment per user block, a metric per event type, values scaled
# to the range each threshold is about.
METRICS = """
SELECT event_id, ts, concat('deploy-', cast(user_id % 20 AS string)) AS deployment_id,
       CASE event_type WHEN 'error' THEN 'error_rate' WHEN 'view' THEN 'response_time'
            WHEN 'click' THEN 'health_score' ELSE 'throughput' END AS metric_name,
       CASE event_type WHEN 'error' THEN value / 1000 WHEN 'view' THEN value * 40
            WHEN 'click' THEN 1 - value / 500 ELSE value END AS value
FROM {events}
"""

# Health-check results: one check per user, failing on error events.
CHECKS = """
SELECT concat('check-', cast(user_id AS string)) AS check_id, concat('deploy-', cast(user_id % 20 AS string)) AS deployment_id,
       ts, event_id, event_type IN ('view', 'click', 'purchase') AS success, value AS response_time
FROM {events}
"""

# Raw observations for a caller-defined check.
OBSERVATIONS = """
SELECT concat('check-', cast(user_id AS string)) AS check_id, concat('deploy-', cast(user_id % 20 AS string)) AS deployment_id, ts, event_id, value AS response_time FROM {events}
"""

# Requests to the limiter: operation by event type; one type has no limit.
REQUESTS = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'migration' WHEN 'view' THEN 'file_ops'
            WHEN 'click' THEN 'api_calls' WHEN 'signup' THEN 'analysis' ELSE 'other' END AS op,
       concat('user-', cast(user_id % 5 AS string)) AS user_id, ts
FROM {events}
"""
