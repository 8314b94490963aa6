"""Options, checked on the driver before a plan is built."""
