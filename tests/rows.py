"""How many rows the joins and aggregates of a plan make."""


def most_rows(df):
    """The most rows that one join or aggregate of the plan gave out when df was collected."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        own = metric.get().value() if metric.isDefined() and ("Join" in name or "Aggregate" in name) else 0
        children = node.children()
        return max([own, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def pinned_rows(monkeypatch, module):
    """The list of most_rows() of what the module pins from now on."""
    seen, pin = [], module.pin

    def told(df):
        seen.append(most_rows(df))
        return pin(df)

    monkeypatch.setattr(module, "pin", told)
    return seen
