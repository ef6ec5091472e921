"""A session: one graph's specifications, its state, and status from its event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SessionState
from ..operators import gating, graph


class SessionError(ValueError):
    pass


class Session:
    def __init__(self, spark: SparkSession, session_id: str):
        self.spark, self.session_id, self.state = spark, session_id, SessionState.PRISTINE
        self.nodes: DataFrame | None = None
        self.edges: DataFrame | None = None

    def add_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Append drops and links; an oid that is there already is refused."""
        if self.state not in (SessionState.PRISTINE, SessionState.BUILDING):
            raise SessionError(f"no graph can be added while {self.state.name}")
        if not {"oid"} <= set(nodes.columns):
            raise SessionError("drops need an oid")
        union = nodes if self.nodes is None else self.nodes.unionByName(nodes, allowMissingColumns=True)
        twice = union.groupBy("oid").count().where("count > 1").first()
        if twice is not None:
            raise SessionError(f"duplicate oid {twice['oid']}")
        self.nodes = union
        self.edges = edges if self.edges is None else self.edges.unionByName(edges, allowMissingColumns=True)
        self.state = SessionState.BUILDING

    def deploy(self) -> DataFrame:
        """Check the links and give the roots that start the graph."""
        if self.state != SessionState.BUILDING:
            raise SessionError(f"cannot deploy while {self.state.name}")
        self.state = SessionState.DEPLOYING
        missing = graph.unmet_relations(self.nodes, self.edges).first()
        if missing is not None:
            self.state = SessionState.FAILED
            raise SessionError(f"link {missing['src']} -> {missing['dst']} has no end")
        self.state = SessionState.RUNNING
        return graph.roots(self.nodes, self.edges)

    def run(self, initial: DataFrame) -> DataFrame:
        """Final status of every drop from that of the roots and of what fails itself."""
        if self.state != SessionState.RUNNING:
            raise SessionError(f"cannot run while {self.state.name}")
        out = gating.propagate(self.nodes, self.edges, initial)
        self.state = SessionState.FINISHED
        return out

    def status(self, events: DataFrame) -> DataFrame:
        """(uid, status): the latest event of each drop of this session; of equal times the
        status that comes last by name."""
        own = events.where(F.col("session_id") == self.session_id)
        return own.groupBy("uid").agg(F.max(F.struct("ts", "status")).alias("m")).select("uid", "m.status")

    def cancel(self) -> None:
        self.state = SessionState.CANCELLED

    def size(self) -> int:
        return 0 if self.nodes is None else self.nodes.count()


class SessionManager:
    """Sessions by id."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sessions = spark, {}

    def create(self, session_id: str) -> Session:
        if session_id in self.sessions:
            raise SessionError(f"session {session_id} exists")
        self.sessions[session_id] = Session(self.spark, session_id)
        return self.sessions[session_id]

    def destroy(self, session_id: str) -> None:
        del self.sessions[session_id]

    def past(self) -> list[str]:
        return sorted(k for k, s in self.sessions.items() if s.state in (SessionState.FINISHED, SessionState.FAILED, SessionState.CANCELLED))
