"""Scan options and their validation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from siltstone.functions.scalars import parse_size


@dataclass(frozen=True)
class Config:
    repo_url: str = "https://repo.maven.apache.org/maven2"
    group: str = ""
    concurrency: int = 10
    qps: float = 0
    resume: bool = False
    retry_failed: bool = False
    state_file: str = ".scan-state.json"
    output: str = "console"
    output_file: str = ""
    max_file_size: str = "50MB"
    timeout: int = 30
    retries: int = 3
    exclude: str = ""
    verbose: bool = False
    checkpoint_interval: int = 50
    rules_level: str = "core"
    rules_file: str = ""
    rules_merge: bool = False
    include_sources: bool = False
    skip_pom: bool = False
    one_file_per_gav: bool = False
    download_concurrency: int = 0
    scan_concurrency: int = 0
    browser_concurrency: int = 0
    disk_budget_mb: int = 1000
    auth_header: str = ""
    auth_token: str = ""
    auth_user: str = ""
    auth_pass: str = ""
    task_id: str = ""
    interval: int = 0

    def validate(self) -> None:
        """Raise ValueError for the first option that makes no sense."""
        checks = [
            (self.repo_url, "repo URL is required"),
            (self.repo_url.startswith(("http://", "https://", "file:", "/")), "repo URL must start with http://, https:// or be a folder"),
            (self.concurrency > 0, "concurrency must be greater than 0"),
            (self.qps >= 0, "QPS must be non-negative"),
            (self.retries >= 0, "retries must be non-negative"),
            (self.timeout > 0, "timeout must be greater than 0"),
            (self.checkpoint_interval >= 0, "checkpoint interval must be non-negative"),
            (self.rules_level in ("core", "extended", "all"), f"rules level must be core, extended or all; got {self.rules_level!r}"),
            (min(self.download_concurrency, self.scan_concurrency, self.browser_concurrency) >= 0, "concurrency must be non-negative"),
            (self.disk_budget_mb >= 0, "disk budget must be non-negative"),
        ]
        for ok, why in checks:
            if not ok:
                raise ValueError(why)
        parse_size(self.max_file_size)

    def snapshot(self) -> dict:
        """Options as a dictionary, without secrets: what a task or a state file keeps."""
        return {k: v for k, v in asdict(self).items() if not k.startswith("auth_")}

    @classmethod
    def from_snapshot(cls, values: dict, **more) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**({k: v for k, v in values.items() if k in known} | more))
