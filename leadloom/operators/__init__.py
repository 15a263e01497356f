"""DataFrame operators: joins, groupings, rankings, model steps and sinks."""
