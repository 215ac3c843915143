"""Schema-mutation packets: ordered folding into a schema, its use on data, and planning of what to send."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

KINDS = ("add", "drop", "rename")
TYPES = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "json": "variant"}


class PacketError(ValueError):
    pass


@dataclass(frozen=True)
class Packet:
    packet_id: str
    collection: str
    kind: str
    field_name: str
    node: str
    sequence: int
    field_type: str = "string"
    nullable: bool = True
    new_name: str | None = None
    first_seen_ns: int = 0


@dataclass
class SchemaCatalog:
    """Fields of each collection, and what was absorbed. Packets are few; the fold runs on the driver."""

    fields: dict[str, dict[str, Packet]] = field(default_factory=dict)
    applied: set[str] = field(default_factory=set)
    high: dict[str, int] = field(default_factory=dict)

    def absorb(self, p: Packet) -> bool:
        """True if applied, False if it was before."""
        if p.packet_id in self.applied:
            return False
        if p.kind not in KINDS or p.field_type not in TYPES:
            raise PacketError(f"unknown kind or type in {p.packet_id}")
        if p.sequence <= self.high.get(p.node, 0):
            raise PacketError(f"{p.packet_id} comes after a later one of {p.node}")
        have = self.fields.setdefault(p.collection, {})
        if p.kind == "add" and p.field_name in have:
            raise PacketError(f"{p.field_name} is there already")
        if p.kind != "add" and p.field_name not in have:
            raise PacketError(f"no field {p.field_name}")
        if p.kind == "rename":
            if not p.new_name or p.new_name in have:
                raise PacketError(f"{p.field_name} can't be renamed to {p.new_name}")
            have[p.new_name] = have.pop(p.field_name)
        elif p.kind == "drop":
            del have[p.field_name]
        else:
            have[p.field_name] = p
        self.applied.add(p.packet_id)
        self.high[p.node] = p.sequence
        return True

    def absorb_all(self, packets: list[Packet]) -> dict[str, int | str | None]:
        """Until the first error: counts of applied and repeated packets, and the error."""
        report: dict[str, int | str | None] = {"applied": 0, "repeated": 0, "error": None}
        for p in packets:
            try:
                report["applied" if self.absorb(p) else "repeated"] += 1  # type: ignore[operator]
            except PacketError as e:
                report["error"] = str(e)
                break
        return report

    def coexistence(self, collection: str, wanted: list[str]) -> dict[str, str]:
        return {f: "Present" if f in self.fields.get(collection, {}) else "Absent" for f in wanted}


def evolve(df: DataFrame, packets: list[Packet]) -> DataFrame:
    """df after the packets, in order."""
    for p in packets:
        if p.kind == "add":
            df = df.withColumn(p.field_name, F.lit(None).cast(TYPES[p.field_type])) if p.field_name not in df.columns else df
        elif p.kind == "drop":
            df = df.drop(p.field_name)
        else:
            df = df.withColumnRenamed(p.field_name, p.new_name or p.field_name)
    return df


def sync_plan(packets: DataFrame, applied: DataFrame, high: DataFrame) -> DataFrame:
    """Packets to send: not applied, after the node's high-water mark, in order (node, sequence, id)."""
    rest = packets.join(applied.select("packet_id"), "packet_id", "left_anti") if applied is not None else packets
    marked = rest.join(high.select("node", F.col("high").alias("_high")), "node", "left")
    return marked.where("origin_sequence > coalesce(_high, 0)").select(*packets.columns).orderBy("node", "origin_sequence", "packet_id")


def buffered(*queues: DataFrame) -> DataFrame:
    """Packets queued while a node was away, each once, in order (node, sequence, id)."""
    out = queues[0]
    for x in queues[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(["packet_id"]).orderBy("node", "origin_sequence", "packet_id")


def catch_up(buffer: DataFrame, applied: DataFrame, high: DataFrame) -> DataFrame:
    """What a delayed node still needs of a buffer."""
    return sync_plan(buffer, applied, high)


def apply_report(entries: DataFrame, seq: str, checkpoint: int) -> DataFrame:
    """(applied, skipped, last): what a replica does with entries, given the last sequence it has; repeats in them are skipped."""
    new = F.col(seq) > checkpoint
    counts = entries.agg(F.count_distinct(F.when(new, F.col(seq))).alias("applied"), F.count("*").alias("n"), F.max(seq).alias("top"))
    return counts.select("applied", (F.col("n") - F.col("applied")).alias("skipped"), F.greatest(F.coalesce("top", F.lit(checkpoint)), F.lit(checkpoint)).alias("last"))


def beyond(packets: DataFrame, high: DataFrame) -> DataFrame:
    """(node, origin_sequence) after the mark of nodes that have one."""
    return packets.join(high, "node").where("origin_sequence > high").select("node", "origin_sequence")


def first_seen(packets: DataFrame, key: str, seq: str) -> DataFrame:
    """Replay guard: the first packet of each key."""
    return packets.groupBy(key).agg(F.min(seq).alias("first_event"))
