"""Audits of document streams: rules are functions of a row, so they run on micro-batches as they are. An extension of the engine."""
