"""Work planning: candidates, staleness, priorities, interleaving, and the merge of run results."""
