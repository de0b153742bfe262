"""Streaming: intentionally empty.

The reference reads three static extracts once per run and has no watermark,
window, session or stateful operator, so there is nothing to re-express with
Structured Streaming. The batch jobs in :mod:`vigilo.plans` are plain
DataFrame plans; pointing them at a ``readStream`` source would need no
operator of its own.
"""
