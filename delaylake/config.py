"""All paths and options of a run, in one place."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Fixed values
SLICES = 10
PAUSE_SECONDS = 15
LINGER_MS = 50
JDBC_BATCH_SIZE = 5000
TRAIN_SHARE = 0.8
SPLIT_SEED = 42
MAX_ITERATIONS = 20
REGULARIZATION = 0.01
RETRIES = 1
RETRY_SECONDS = 300

#: How messages and staged records are stored: they repeat names and values over long stretches.
MESSAGE_CODEC = "zstd"
#: Rows of a file of messages, of silver or of the training table at most. A few large files pack badly
#: into the tasks of the next step: one more file than cores takes twice as long.
FILE_ROWS = 250_000

#: Files that a micro-batch takes at most, and so what is landed again after a failure.
FILES_PER_BATCH = 1000

#: How long after its first sending a message may come again and is still known.
ONCE_WITHIN = "7 days"


@dataclass(frozen=True)
class KafkaTopic:
    """A topic and the brokers that serve it."""

    servers: str
    topic: str
    starting_offsets: str = "earliest"
    max_offsets_per_trigger: int | None = None
    linger_ms: int = LINGER_MS


@dataclass(frozen=True)
class JdbcTarget:
    """A relational table. Credentials come from the caller, never from source code."""

    url: str
    table: str
    user: str | None = field(default=None, repr=False)
    password: str | None = field(default=None, repr=False)
    driver: str | None = None
    batch_size: int = JDBC_BATCH_SIZE
    max_connections: int = 32

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> JdbcTarget | None:
        """Target named by ``DELAYLAKE_JDBC_*``, or None when no URL is set. With a URL the
        table must be named too."""
        url = env.get("DELAYLAKE_JDBC_URL")
        if not url:
            return None
        return cls(
            url=url,
            table=env["DELAYLAKE_JDBC_TABLE"],
            user=env.get("DELAYLAKE_JDBC_USER"),
            password=env.get("DELAYLAKE_JDBC_PASSWORD"),
            driver=env.get("DELAYLAKE_JDBC_DRIVER"),
        )


@dataclass(frozen=True)
class LakeConfig:
    """One run over one lake folder."""

    root: str
    source_csv: str | None = None
    slices: int = SLICES
    pause_seconds: float = 0.0
    files_per_batch: int | None = FILES_PER_BATCH
    silver_partitions: tuple[str, ...] = ()
    kafka: KafkaTopic | None = None
    jdbc: JdbcTarget | None = None
    train_share: float = TRAIN_SHARE
    use_delays: bool = True
    random_split: bool = False
    max_iterations: int = MAX_ITERATIONS
    regularization: float = REGULARIZATION
    line_breaks: bool | None = None
    once_within: str | None = ONCE_WITHIN
    #: Silver takes only what is new in bronze, in parts by batch, and keeps states of summaries.
    incremental: bool = False
    #: Note each attempt at a step, try again after a failure, and take up a run that was cut off.
    ledger: bool = False
    retries: int = RETRIES
    retry_seconds: float = RETRY_SECONDS

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def records(self) -> str:
        return self.path("records")

    @property
    def sliced(self) -> str:
        return self.path("sliced")

    @property
    def landing(self) -> str:
        return self.path("landing")

    @property
    def sent(self) -> str:
        return self.path("sent")

    @property
    def bronze(self) -> str:
        return self.path("bronze")

    @property
    def bronze_checkpoint(self) -> str:
        return self.path("checkpoints/bronze")

    @property
    def silver(self) -> str:
        return self.path("silver")

    @property
    def fact(self) -> str:
        return self.path("fact")

    @property
    def training(self) -> str:
        return self.path("training")

    @property
    def model(self) -> str:
        return self.path("model")
