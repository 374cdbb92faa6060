"""Streams into datasets: an extension, for sources that arrive continuously."""
