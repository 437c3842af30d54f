"""Sources and sinks: files to cells, texts and segments; results to tables, Markdown and manifests."""
