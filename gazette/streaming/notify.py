"""Notices of what runs did, sent from a stream's batches. A notifier that fails is reported and never ends the stream."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redact import redact

NOTICES = "run_id string, subject string, body string"


class Notifier(Protocol):
    name: str

    def send(self, subject: str, body: str) -> None: ...


class IssueNotifier:
    """Opens an issue by `post`, which gets the address and the fields; the job that runs this decides how to reach the network."""

    name = "issue"

    def __init__(self, post: Callable[[str, dict], None], url: str, labels: tuple[str, ...] = ()):
        self.post, self.url, self.labels = post, url, labels

    def send(self, subject: str, body: str) -> None:
        self.post(self.url, {"title": subject, "body": body, "labels": list(self.labels)})


class MailNotifier:
    """Sends a message by `deliver`, which gets sender, recipients, subject and text."""

    name = "mail"

    def __init__(self, deliver: Callable[[str, tuple[str, ...], str, str], None], sender: str, to: tuple[str, ...]):
        self.deliver, self.sender, self.to = deliver, sender, to

    def send(self, subject: str, body: str) -> None:
        self.deliver(self.sender, self.to, subject, body)


def notify_batch(notifiers: list[Notifier], report: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over NOTICES, one notice a run: what is sent, and what is reported of a failure, is redacted. A run without a subject is sent to no one."""

    def send(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter("subject is not null").groupBy("run_id").agg(F.min(F.struct("subject", "body")).alias("n"))
        for r in rows.select("run_id", redact(F.col("n.subject")).alias("subject"), redact(F.coalesce("n.body", F.lit(""))).alias("body")).orderBy("run_id").toLocalIterator():
            for notifier in notifiers:
                try:
                    notifier.send(r.subject, r.body)
                except Exception as e:  # noqa: BLE001  whatever a notifier raises, the others and the stream go on
                    said = batch.sparkSession.range(1).select(redact(F.lit(f"{notifier.name}: {type(e).__name__}: {e}"))).first()[0]
                    report(said)

    return send
