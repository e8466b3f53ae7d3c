"""Jobs made of several steps: the KPI refresh and the archive run."""
