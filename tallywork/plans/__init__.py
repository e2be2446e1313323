"""Multi-step jobs that put the operators together in a fixed order."""
