"""A made-up corpus of secrets from the customer table, the same in SQL and DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For c_custkey mod 37: file name and line; h stands for md5 of the key as text, h(a,n) for n
#: characters of it from the a-th.
TEMPLATES = [
    ("app.properties", "concat('db.password=', h)"),
    ("Main.java", "concat('key=AKIA', upper(substr(h,1,16)))"),
    ("id.pem", "'-----BEGIN RSA PRIVATE KEY-----'"),
    ("ds.xml", "concat('url=jdbc:mysql://db/x?user=', substr(h,1,8))"),
    ("deploy.sh", "concat('tok ghp_', h, substr(h,1,4))"),
    ("app.conf", "concat('api_key=', h)"),
    ("a.json", "concat('AIza', h, 'abc')"),
    ("b.txt", "concat('ya29.', h)"),
    ("c.config", "concat('DefaultEndpointsProtocol=https;AccountName=acct;AccountKey=', h, h, substr(h,1,24))"),
    ("app.yml", "concat('azure_client_secret=', h, 'abcd')"),
    ("sa.json", "'\"type\": \"service_account\"'"),
    ("d.env", "concat('dop_v1_', h, h)"),
    ("m.yaml", "concat('mongodb://u:', h, '@host/db')"),
    ("m.properties", "concat('mysql://u:', h, '@host/db')"),
    ("p.conf", "concat('postgresql://u:', h, '@host/db')"),
    ("r.json", "concat('redis://:', h, '@host')"),
    ("s.xml", "concat('db_user=', substr(h,1,8))"),
    ("t.md", "concat('xoxb-1234567890-1234567890-', substr(h,1,24))"),
    ("w.txt", "concat('https://hooks.slack.com/services/T', substr(h,1,8), '/B', substr(h,9,8), '/', substr(h,1,24))"),
    ("x.kt", "concat('sk_live_', h)"),
    ("y.toml", "concat('SG.', substr(h,1,22), '.', h, substr(h,1,11))"),
    ("z.cfg", "concat('key-', h)"),
    ("u.ini", "concat('SK', h)"),
    ("v.bat", "concat('sq0atp-', substr(h,1,22))"),
    (".npmrc", "concat('//registry.npmjs.org/:_authToken=', substr(h,1,8), '-', substr(h,9,4), '-', substr(h,13,4), '-', substr(h,17,4), '-', substr(h,21,12))"),
    ("id.key", "'-----BEGIN OPENSSH PRIVATE KEY-----'"),
    ("pgp.bak", "'-----BEGIN PGP PRIVATE KEY BLOCK-----'"),
    ("j.env", "concat('jwt_secret=', h)"),
    ("e.yml", "concat('aes_key=', h)"),
    ("h.rst", "concat('Authorization: Basic ', h)"),
    ("k.json", "concat('auth_token=', h)"),
    ("o.properties", "concat('client_secret=', h)"),
    ("settings.xml", "concat('<password>', h, '</password>')"),
    ("build.gradle", "concat('gpg_passphrase=', h)"),
    ("application.yml", "concat('spring.datasource.password=', h)"),
    ("docker.config", "concat('\"auth\": \"', h, '\"')"),
    ("f.scala", "concat('AIzaSy', h, 'a')"),
]


def corpus_sql(text_type: str) -> str:
    """The corpus as SQL over ``customer``: k, g, a, v, file_path, line, status."""
    files = " ".join(f"WHEN {i} THEN '{f}'" for i, (f, _) in enumerate(TEMPLATES))
    lines = " ".join(f"WHEN {i} THEN {e}" for i, (_, e) in enumerate(TEMPLATES))
    return (
        f"SELECT k, concat('org.g', CAST(k % 7 AS {text_type})) AS group_id, concat('a', CAST(k % 11 AS {text_type})) AS artifact_id, concat('1.', CAST(k % 5 AS {text_type})) AS version, "
        f"CASE k % 37 {files} END AS file_path, CASE k % 37 {lines} END AS line "
        f"FROM (SELECT c_custkey AS k, md5(CAST(c_custkey AS {text_type})) AS h FROM customer) AS c0"
    )


def secret_lines(customer: DataFrame) -> DataFrame:
    """(k, group_id, artifact_id, version, file_path, line, line_number)."""
    sql = corpus_sql("string").replace("FROM customer", "FROM {customer}")
    return customer.sparkSession.sql(sql, customer=customer).withColumn("line_number", F.lit(1))
