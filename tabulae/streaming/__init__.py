"""Streaming.

The reference processes batch tables only: it has no watermark, window,
state or late-data handling. No streaming operator is built here; every
operator in this package is a batch DataFrame job. A scored stream can
still be evaluated by calling ``operators.metrics.evaluate_by`` on each
micro-batch from ``foreachBatch``.
"""
