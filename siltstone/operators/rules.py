"""Detection rules: the built-in sets, YAML loading, level selection and merging."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


@dataclass(frozen=True)
class Entropy:
    threshold: float = 4.5
    window: int = 32
    min_length: int = 20
    max_length: int = 0
    charset: str = "base64"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str = ""
    severity: str = ""
    description: str = ""
    patterns: tuple[str, ...] = ()
    file_patterns: tuple[str, ...] = ()
    enabled: bool = False
    engine: str = ""
    ignorecase: bool = False
    capture_group: int = 0
    allowlist: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    min_length: int = 0
    max_length: int = 0
    entropy: Entropy | None = None
    #: A line without any of these (lower case) can't match; empty: always tried.
    keywords: tuple[str, ...] = field(default=())


# Names, patterns and files of the built-in rules, which must be equal for equal findings.
ANY = (r"\..+$",)
PROPERTIES, XML, YAML, JSON, CONF, ENV = r"\.properties$", r"\.xml$", r"\.ya?ml$", r"\.json$", r"\.conf$", r"\.env$"
CORE_ROWS = [
    ("hardcoded-password", "Hardcoded Password", "CRITICAL", "Detects hardcoded passwords in configuration files", r"""(?i)(password|passwd|pwd)\s*[=:]\s*["\']?[^\s"\'{}]{6,}""", (PROPERTIES, XML, YAML, JSON, CONF, r"\.cfg$", r"\.ini$"), ("password", "passwd", "pwd")),
    ("aws-secret-key", "AWS Secret Key", "HIGH", "Detects AWS secret access keys", r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}", ANY, ("a3t", "akia", "agpa", "aida", "aroa", "aipa", "anpa", "anva", "asia")),
    ("private-key", "Private Key", "CRITICAL", "Detects PEM format private keys", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----", ANY, ("private key-----",)),
    ("jdbc-credentials", "JDBC Credentials", "HIGH", "Detects credentials in JDBC connection strings", r"jdbc:[a-z]+://[^\s]+[?&](?:user|password)=[^\s&]+", (PROPERTIES, XML, YAML), ("jdbc:",)),
    ("github-token", "GitHub Token", "HIGH", "Detects GitHub personal access tokens", r"gh[ps]_[A-Za-z0-9_]{36,255}", ANY, ("ghp_", "ghs_")),
    ("generic-api-key", "Generic API Key", "MEDIUM", "Detects generic API key patterns", r"""(?i)(api[_-]?key|apikey|secret[_-]?key)\s*[=:]\s*["\']?[A-Za-z0-9+/=]{20,}""", (PROPERTIES, XML, YAML, JSON, CONF), ("api", "secret")),
]
EXTENDED_ROWS = [
    ("google-api-key", "Google API Key", "HIGH", "Detects Google API keys (AIza...)", r"AIza[0-9A-Za-z\-_]{35}", ANY, ("aiza",)),
    ("google-oauth", "Google OAuth Access Token", "HIGH", "Detects Google OAuth access tokens (ya29...)", r"ya29\.[0-9A-Za-z\-_]+", ANY, ("ya29.",)),
    ("azure-storage-key", "Azure Storage Account Key", "HIGH", "Detects Azure storage account shared keys", r"DefaultEndpointsProtocol=https;AccountName=[^;]+;AccountKey=[A-Za-z0-9+/=]{88}", ANY, ("accountkey=",)),
    ("azure-tenant-secret", "Azure Tenant Secret", "HIGH", "Detects Azure client secrets", r"""(?i)azure[_\-]?client[_\-]?secret\s*[=:]\s*["\']?[A-Za-z0-9\-_.~]{34,42}""", (PROPERTIES, YAML, JSON), ("azure",)),
    ("gcp-service-account", "GCP Service Account Key", "CRITICAL", "Detects GCP service account private key in JSON", r'"type"\s*:\s*"service_account"', (JSON,), ("service_account",)),
    ("digitalocean-token", "DigitalOcean Token", "HIGH", "Detects DigitalOcean API tokens (dop_v1_...)", r"dop_v1_[a-f0-9]{64}", ANY, ("dop_v1_",)),
    ("mongodb-connection", "MongoDB Connection String", "HIGH", "Detects MongoDB connection strings with credentials", r"mongodb(\+srv)?://[^:\s]+:[^@\s]+@[^\s]+", (PROPERTIES, YAML, JSON, CONF), ("mongodb",)),
    ("mysql-connection", "MySQL Connection String", "HIGH", "Detects MySQL connection strings with credentials", r"(?i)mysql://[^:\s]+:[^@\s]+@[^\s]+", (PROPERTIES, YAML, JSON, CONF), ("mysql://",)),
    ("postgres-connection", "PostgreSQL Connection String", "HIGH", "Detects PostgreSQL connection strings with credentials", r"(?i)(?:postgres|postgresql)://[^:\s]+:[^@\s]+@[^\s]+", (PROPERTIES, YAML, JSON, CONF), ("postgres",)),
    ("redis-connection", "Redis Connection String", "MEDIUM", "Detects Redis connection strings with passwords", r"(?i)redis://:[^@\s]+@[^\s]+", (PROPERTIES, YAML, JSON, CONF), ("redis://:",)),
    ("sql-credential", "SQL Credential in Config", "HIGH", "Detects SQL username/password pairs in config files", r"""(?i)(?:db[_\-]?user|database[_\-]?user|sql[_\-]?user)\s*[=:]\s*["\']?[^\s"'<>]{3,}""", (PROPERTIES, YAML, XML), ("user",)),
    ("slack-token", "Slack Token", "HIGH", "Detects Slack bot/user/workspace tokens (xoxb/xoxp/xoxa/xoxs-...)", r"xox[bpras]-[0-9]{10,13}-[0-9]{10,13}-[a-zA-Z0-9]{24,34}", ANY, ("xox",)),
    ("slack-webhook", "Slack Webhook URL", "MEDIUM", "Detects Slack webhook URLs", r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]{8,}/B[a-zA-Z0-9_]{8,}/[a-zA-Z0-9_]{24}", ANY, ("hooks.slack.com",)),
    ("stripe-api-key", "Stripe API Key", "CRITICAL", "Detects Stripe secret/live API keys (sk_live/rk_live)", r"(?:sk|rk)_live_[0-9a-zA-Z]{24,}", ANY, ("_live_",)),
    ("sendgrid-api-key", "SendGrid API Key", "HIGH", "Detects SendGrid API keys (SG...)", r"SG\.[0-9A-Za-z\-_]{22}\.[0-9A-Za-z\-_]{43}", ANY, ("sg.",)),
    ("mailgun-api-key", "Mailgun API Key", "HIGH", "Detects Mailgun API keys (key-...)", r"key-[0-9a-zA-Z]{32}", ANY, ("key-",)),
    ("twilio-api-key", "Twilio API Key", "HIGH", "Detects Twilio API keys (SK...)", r"SK[0-9a-fA-F]{32}", ANY, ("sk",)),
    ("square-access-token", "Square Access Token", "HIGH", "Detects Square access tokens (sq0atp-...)", r"sq0atp-[0-9A-Za-z\-_]{22}", ANY, ("sq0atp-",)),
    ("npm-token", "NPM Access Token", "HIGH", "Detects NPM access tokens in .npmrc files", r"(?i)//registry\.npmjs\.org/:_authToken=[0-9a-f-]{36}", (r"\.npmrc$",), ("_authtoken=",)),
    ("ssh-private-key", "SSH Private Key", "CRITICAL", "Detects SSH private keys (DSA/EC/RSA/OPENSSH/ED25519)", r"-----BEGIN (?:OPENSSH |EC |DSA |RSA |ED25519 )?PRIVATE KEY-----", ANY, ("private key-----",)),
    ("pgp-private-key", "PGP Private Key Block", "CRITICAL", "Detects PGP private key blocks", r"-----BEGIN PGP PRIVATE KEY BLOCK-----", ANY, ("pgp private",)),
    ("jwt-secret", "JWT Secret", "HIGH", "Detects JWT signing secrets in configuration files", r"""(?i)(?:jwt[_\-]?secret|jwt[_\-]?key|token[_\-]?secret)\s*[=:]\s*["\']?[^\s"'<>{}]{16,}""", (PROPERTIES, YAML, JSON, ENV), ("jwt", "token")),
    ("encryption-key", "Encryption Key in Config", "HIGH", "Detects hardcoded encryption/AES keys in config", r"""(?i)(?:encryption[_\-]?key|aes[_\-]?key)\s*[=:]\s*["\']?[A-Za-z0-9+/=]{16,}""", (PROPERTIES, YAML, JSON, ENV), ("encryption", "aes")),
    ("basic-auth-header", "Basic Auth Header", "MEDIUM", "Detects Basic authentication headers", r"(?i)Authorization\s*:\s*Basic\s+[A-Za-z0-9+/=]{6,}", ANY, ("authorization",)),
    ("bearer-token", "Bearer Token", "MEDIUM", "Detects Bearer token in Authorization headers or config", r"""(?i)(?:bearer[_\-]?token|auth[_\-]?token)\s*[=:]\s*["\']?[A-Za-z0-9\-_.~+/=]{20,}""", (PROPERTIES, YAML, JSON, ENV), ("bearer", "auth")),
    ("oauth-client-secret", "OAuth Client Secret", "HIGH", "Detects OAuth client secrets in configuration", r"""(?i)(?:client[_\-]?secret|oauth[_\-]?secret)\s*[=:]\s*["\']?[A-Za-z0-9\-_.~]{20,}""", (PROPERTIES, YAML, JSON, ENV), ("secret",)),
    ("maven-password-xml", "Maven Settings Password", "CRITICAL", "Detects passwords in Maven settings.xml", r"<password>\s*\S+\s*</password>", (XML,), ("<password>",)),
    ("maven-passphrase", "Maven GPG Passphrase", "HIGH", "Detects GPG passphrases in Maven settings or CI config", r"""(?i)(?:gpg[_\-]?passphrase|signing[_\-]?key[_\-]?password)\s*[=:]\s*["\']?[^\s"'<>]{6,}""", (PROPERTIES, XML, YAML, r"\.gradle$"), ("gpg", "signing")),
    ("spring-credential", "Spring Boot Credential", "HIGH", "Detects Spring Boot datasource credentials in properties", r"(?i)spring\.datasource\.(?:password|username)\s*=\s*\S+", (PROPERTIES, YAML), ("spring.datasource.",)),
    ("docker-registry-auth", "Docker Registry Auth", "MEDIUM", "Detects Docker registry authentication in config files", r'"(?:auth|email|password|username|serveraddress)"\s*:\s*"[^"]{5,}"', (JSON, r"\.config$"), ('auth"', 'email"', 'password"', 'username"', 'serveraddress"')),
    ("firebase-key", "Firebase API Key", "MEDIUM", "Detects Firebase web API keys (AIzaSy...)", r"AIzaSy[a-zA-Z0-9\-_]{33}", ANY, ("aizasy",)),
]
HIGH_ENTROPY = Rule(
    id="high-entropy-secret",
    name="High Entropy Secret",
    severity="MEDIUM",
    description="Detects high-entropy (random) strings that look like secrets but match no known format",
    file_patterns=(PROPERTIES, YAML, JSON, CONF, ENV, r"\.sh$", XML),
    enabled=True,
    engine="entropy",
    allowlist=("EXAMPLE", "example", "changeme", "your-", "placeholder", "test"),
    tags=("entropy", "generic"),
    entropy=Entropy(4.5, 32, 24, 0, "base64"),
)
# End of fixed values.


def _built(row: tuple) -> Rule:
    rule_id, name, severity, description, pattern, files, keywords = row
    return Rule(rule_id, name, severity, description, (pattern,), files, True, keywords=keywords)


CORE = tuple(map(_built, CORE_ROWS))
EXTENDED = (*map(_built, EXTENDED_ROWS), HIGH_ENTROPY)
LEVELS = {"core": CORE, "extended": EXTENDED, "all": CORE + EXTENDED}


def builtin(level: str = "core") -> list[Rule]:
    """The rules of a level; an unknown level means core."""
    return list(LEVELS.get(level, CORE))


def merge(base: Iterable[Rule], custom: Iterable[Rule]) -> list[Rule]:
    """Custom rules replace built-in ones of their id in place and others follow; among equal ids the
    first built-in and the last custom one count."""
    found: dict[str, Rule] = {}
    for rule in base:
        found.setdefault(rule.id, rule)
    for rule in custom:
        found[rule.id] = rule
    return list(found.values())


def parse_yaml(text: str) -> list[Rule]:
    """Rules of a YAML document with a top-level ``rules`` list; what is missing is empty or off."""
    import yaml

    known = Rule.__dataclass_fields__
    rules = []
    for entry in (yaml.safe_load(text) or {}).get("rules") or []:
        values = {k: v for k, v in entry.items() if k in known and k not in ("entropy", "keywords") and v is not None}
        for k in ("patterns", "file_patterns", "allowlist", "tags"):
            values[k] = tuple(map(str, values.get(k, ())))
        values["id"] = str(values.get("id", ""))
        rule = Rule(**values)
        if entry.get("entropy") is not None or rule.engine == "entropy":
            given = entry.get("entropy") or {}
            rule = replace(rule, entropy=with_defaults(Entropy(float(given.get("threshold", 0)), int(given.get("window", 0)), int(given.get("min_length", 0)), int(given.get("max_length", 0)), str(given.get("charset") or ""))))
        rules.append(rule)
    return rules


def with_defaults(e: Entropy | None) -> Entropy:
    """Values that are not positive, or empty, become the defaults."""
    e, d = e or Entropy(), Entropy()
    return Entropy(e.threshold if e.threshold > 0 else d.threshold, e.window if e.window > 0 else d.window, e.min_length if e.min_length > 0 else d.min_length, e.max_length, e.charset or d.charset)


def load(path: str | None = None, level: str = "core", merged: bool = False) -> list[Rule]:
    """Built-in rules of a level; those of a file instead; or the file's laid over the level's."""
    if not path:
        return builtin(level)
    from pathlib import Path

    custom = parse_yaml(Path(path).read_text(encoding="utf-8"))
    return merge(builtin(level), custom) if merged else custom


SCHEMA = (
    "rule_ord int, level string, id string, name string, severity string, description string, patterns array<string>, file_patterns array<string>, "
    "enabled boolean, engine string, ignorecase boolean, capture_group int, allowlist array<string>, tags array<string>, min_length int, max_length int, "
    "entropy struct<threshold:double,window:int,min_length:int,max_length:int,charset:string>"
)


def to_table(spark: SparkSession, rules: Iterable[Rule], level: str = "custom") -> DataFrame:
    """Rules as a table; ``rule_ord`` is their place in the list."""
    rows = []
    for i, r in enumerate(rules):
        e = r.entropy and (r.entropy.threshold, r.entropy.window, r.entropy.min_length, r.entropy.max_length, r.entropy.charset)
        rows.append((i, level, r.id, r.name, r.severity, r.description, list(r.patterns), list(r.file_patterns), r.enabled, r.engine, r.ignorecase, r.capture_group, list(r.allowlist), list(r.tags), r.min_length, r.max_length, e))
    return spark.createDataFrame(rows, SCHEMA)


def level_table(spark: SparkSession) -> DataFrame:
    """All built-in rules with their level."""
    both = to_table(spark, CORE, "core").unionByName(to_table(spark, EXTENDED, "extended"))
    return both


def merge_tables(base: DataFrame, custom: DataFrame) -> DataFrame:
    """``merge`` on rule tables: one row per id, in the merged order."""
    first = Window.partitionBy("id").orderBy("rule_ord")
    last = Window.partitionBy("id").orderBy(F.col("rule_ord").desc())
    b = base.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    start = Window.partitionBy("id")
    c = custom.withColumn("_first", F.min("rule_ord").over(start)).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    place = b.select("id", F.col("rule_ord").alias("_base"))
    won = c.join(place, "id", "left").withColumn("_rank", F.struct(F.when(F.col("_base").isNotNull(), 0).otherwise(1).alias("late"), F.coalesce("_base", "_first").alias("ord")))
    kept = b.join(c.select("id"), "id", "left_anti").withColumn("_rank", F.struct(F.lit(0).alias("late"), F.col("rule_ord").alias("ord")))
    names = [x for x in base.columns if x != "rule_ord"]
    rows = kept.select(*names, "_rank").unionByName(won.select(*names, "_rank"))
    return rows.withColumn("rule_ord", (F.row_number().over(Window.orderBy("_rank")) - 1).cast("int")).select(*base.columns)
