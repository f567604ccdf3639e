"""Event-time analytics over telemetry and feedback of language-model services, as Spark plans."""
