"""Where statements come from: text lines, positioned tokens, ledgers derived from tables; and the export sinks."""
