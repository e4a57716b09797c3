"""The step graph of a flow, drawn and listed; and what Spark makes of it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from ..stream import Flow, Step

__all__ = ["RenderedOperator", "RenderedPort", "explain", "to_json", "to_mermaid", "to_plantuml", "to_rendered"]


@dataclass(frozen=True)
class RenderedPort:
    """A named end of a step, and the ports whose rows come to it."""

    port_id: str
    name: str
    from_port_ids: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class RenderedOperator:
    """A step as drawn: its kind, ports and inner steps."""

    op_type: str
    op_name: str
    step_id: str
    inp_ports: list[RenderedPort]
    out_ports: list[RenderedPort]
    substeps: list[RenderedOperator]


def _rendered(step: Step) -> RenderedOperator:
    inputs = [RenderedPort(f"{step.step_id}.{n}", n, list(ids)) for n, ids in step.ups.items()]
    outputs = [RenderedPort(i, n) for n, i in step.downs.items()]
    return RenderedOperator(step.kind, step.step_id.rsplit(".", 1)[-1], step.step_id, inputs, outputs, [_rendered(s) for s in step.substeps])


def to_rendered(flow: Flow) -> list[RenderedOperator]:
    """The flow's outer steps, with those inside."""
    return [_rendered(s) for s in flow.steps]


def to_json(flow: Flow) -> str:
    """The graph as JSON."""
    return json.dumps({"flow_id": flow.flow_id, "operators": [asdict(r) for r in to_rendered(flow)]}, indent=2)


def _edges(flow: Flow) -> list[tuple[str, str, str]]:
    """(from step, to step, label) between outer steps."""
    owner = {stream: s.step_id for s in flow.steps for stream in s.downs.values()}
    out = []
    for s in flow.steps:
        for name, ids in s.ups.items():
            for i in ids:
                if (source := owner.get(i) or next((o for o in owner.values() if i.startswith(o + ".")), None)) is not None:
                    out.append((source, s.step_id, f"{i.rsplit('.', 1)[-1]} → {name}"))
    return out


def to_mermaid(flow: Flow) -> str:
    """The outer steps as a Mermaid flowchart."""
    lines = ["flowchart TD", f'subgraph "{flow.flow_id} (Flow)"']
    lines += [f'{s.step_id}["{s.step_id.rsplit(".", 1)[-1]} ({s.kind})"]' for s in flow.steps]
    lines += [f'{a} -- "{label}" --> {b}' for a, b, label in _edges(flow)]
    return "\n".join([*lines, "end"])


def to_plantuml(flow: Flow, recursive: bool = False) -> str:
    """The steps as PlantUML components; with recursive, inner ones too."""
    lines = ["@startuml"]

    def add(step: Step, depth: int) -> None:
        pad = "  " * depth
        inner = step.substeps if recursive else []
        lines.append(f"{pad}component {step.step_id} [{step.step_id.rsplit('.', 1)[-1]} ({step.kind})]" if not inner else f"{pad}component {step.step_id} {{")
        for s in inner:
            add(s, depth + 1)
        if inner:
            lines.append(f"{pad}}}")

    for s in flow.steps:
        add(s, 0)
    lines += [f"{a} --> {b} : {label}" for a, b, label in _edges(flow)]
    return "\n".join([*lines, "@enduml"])


def explain(flow: Flow, mode: str = "formatted") -> str:
    """Spark's plan of each output."""
    out = []
    for step_id, up, _ in flow.outputs:
        plan = up.df._jdf.queryExecution()
        text = plan.explainString(up.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        out.append(f"== {step_id}\n{text}")
    return "\n".join(out)
