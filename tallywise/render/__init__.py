"""Text renderings of small results, on the driver."""
