"""DataFrame-to-DataFrame operators: extraction, queue, verdicts, reports."""
