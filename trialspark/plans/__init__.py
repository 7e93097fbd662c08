"""Multi-step jobs: loading folders, planning fetches, catalog and guarded SQL."""
