"""Tables read and written: judged facts of test tables, caches, providers and the latency log."""
