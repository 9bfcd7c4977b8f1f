"""Sources: text, Markdown and Word documents to blocks; specifications; folders."""
