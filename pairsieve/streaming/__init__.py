"""The triage plan over a stream of candidate pairs."""
