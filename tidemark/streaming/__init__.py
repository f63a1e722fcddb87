"""Structured Streaming forms.

The source systems define no lateness; here the watermark is 10 minutes of event
time and rows behind it are dropped.
"""

WATERMARK = "10 minutes"
BATCH_SECONDS = "5 seconds"
