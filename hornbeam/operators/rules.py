"""Tracing rules: a language of macros, lists and conditions, compiled to Columns over syscall events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.functions.names import in_network

_TOKEN = re.compile(r"\s*(\(|\)|,|!=|<=|>=|=|<|>|\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\s()=!<>,]+)")
_COMPARE = {"=", "!=", "<", ">", "<=", ">="}
_WORDS = {"contains", "icontains", "startswith", "endswith", "in", "pmatch", "exists", "glob"}


class Rules:
    """Lists (name -> values), macros and rules (name -> condition). Fields are columns whose dots are underscores.

    Conditions: `and`, `or`, `not`, brackets, macros by name, `field op value`, `field in (values or lists)`, `field
    pmatch (paths)` (the value is a path or below it), `field exists`. A value that is a network like 10.0.0.0/8 is
    compared as one. Nulls make a comparison false."""

    def __init__(self, lists: dict[str, list[str]] | None = None, macros: dict[str, str] | None = None, rules: dict[str, str] | None = None):
        self.fields: set[str] = set()  # columns that conditions have asked for
        self.lists, self.macros, self.rules = dict(lists or {}), {"always_true": "true", "never_true": "false"} | dict(macros or {}), dict(rules or {})

    def column(self, condition: str, open_: tuple[str, ...] = ()) -> Column:
        tokens = [t.strip("\"'") if t[0] in "\"'" else t for t in _TOKEN.findall(condition)]
        at = 0

        def peek() -> str | None:
            return tokens[at] if at < len(tokens) else None

        def take(want: str | None = None) -> str:
            nonlocal at
            t = peek()
            if t is None or (want is not None and t != want):
                raise ValueError(f"{want or 'more'} was expected in {condition!r}")
            at += 1
            return t

        def either() -> Column:
            out = both()
            while peek() == "or":
                take()
                out = out | both()
            return out

        def both() -> Column:
            out = one()
            while peek() == "and":
                take()
                out = out & one()
            return out

        def values() -> list[str]:
            take("(")
            out = []
            while peek() != ")":
                t = take()
                if t != ",":
                    out += self.lists.get(t, [t])
            take(")")
            return out

        def one() -> Column:
            t = take()
            if t == "not":
                return ~one()
            if t == "(":
                out = either()
                take(")")
                return out
            if peek() in _COMPARE or peek() in _WORDS:
                return self._test(t, take(), values, take)
            if t in ("true", "false"):
                return F.lit(t == "true")
            if t not in self.macros:
                raise ValueError(f"no macro {t!r}")
            if t in open_:
                raise ValueError(f"macro {t!r} contains itself")
            return self.column(self.macros[t], (*open_, t))

        out = either()
        if peek() is not None:
            raise ValueError(f"{peek()!r} follows the condition {condition!r}")
        return out

    def _test(self, name: str, op: str, values, take) -> Column:
        column = name.replace(".", "_").replace("[", "_").replace("]", "")
        self.fields.add(column)
        field, out = F.col(column), F.lit(False)
        text = field.cast("string")
        if op == "exists":
            return field.isNotNull()
        if op in ("in", "pmatch"):
            found = values()
            networks = [v for v in found if re.fullmatch(r"\d+(\.\d+){3}/\d+", v)]
            plain = [v for v in found if v not in networks]
            if op == "pmatch":
                for v in plain:
                    out = out | (text == v) | text.startswith(v.rstrip("/") + "/")
            else:
                out = text.isin(plain) if plain else out
                for v in networks:
                    out = out | in_network(text, v)
        else:
            v = take()
            lower = F.lower(text)
            out = {
                "=": lambda: in_network(text, v) if re.fullmatch(r"\d+(\.\d+){3}/\d+", v) else text == v, "!=": lambda: text != v, "contains": lambda: text.contains(v), "icontains": lambda: lower.contains(v.lower()),
                "startswith": lambda: text.startswith(v), "endswith": lambda: text.endswith(v), "glob": lambda: text.rlike("^" + re.escape(v).replace(r"\*", ".*").replace(r"\?", ".") + "$"),
                "<": lambda: (text == v) if v in "<>" else field < float(v), ">": lambda: field > float(v), "<=": lambda: field <= float(v), ">=": lambda: field >= float(v),
            }[op]()
        return F.coalesce(out, F.lit(False))

    def alerts(self, events: DataFrame) -> DataFrame:
        """events with the rule that fits; an event that fits several rules gives a row for each. Fields that events do
        not have count as null."""
        fits = [F.when(self.column(c), F.lit(name)) for name, c in self.rules.items()]
        missing = sorted(self.fields - set(events.columns))
        every = events.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else events
        return every.withColumn("rule", F.explode(F.filter(F.array(*fits), lambda x: x.isNotNull()))).drop(*missing)


#: What package installs are watched for; names and paths are parameters of the macros' lists.
WATCH = Rules(
    lists={
        "registries": ["pypi.org", "files.pythonhosted.org", "registry.npmjs.org", "rubygems.org", "packagist.org", "repo.maven.apache.org"],
        "local_networks": ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"],
        "binary_dirs": ["/bin", "/sbin", "/usr/bin", "/usr/sbin"],
        "secret_files": ["/etc/shadow", "/etc/sudoers", "/etc/pam.conf"],
        "shell_files": [".bashrc", ".profile", ".bash_profile", ".zshrc"],
        "shells": ["bash", "sh", "zsh", "dash", "ksh", "csh"],
        "network_tools": ["nc", "ncat", "nmap", "dig", "tcpdump", "tshark", "ngrep", "telnet", "socat"],
        "copy_tools": ["rsync", "scp", "sftp", "dcp"],
        "databases": ["mysqld", "postgres", "redis-server", "mongod"],
        "servers": ["httpd", "nginx", "apache2", "node", "java"],
        "system_processes": ["cat", "chmod", "chown", "cp", "date", "df", "ls", "mkdir", "mv", "rm", "rmdir", "touch", "useradd", "passwd", "shadowconfig"],
        "system_users": ["bin", "daemon", "games", "lp", "mail", "nobody", "sshd", "uucp", "www-data"],
        "usual_users": ["root", "builder", "N/A"],
        "usual_ports": ["53", "67", "68", "123"],
        "search_tools": ["grep", "egrep", "find", "locate", "ag"],
        "devices": ["/dev/null", "/dev/tty", "/dev/stdin", "/dev/stdout", "/dev/stderr", "/dev/random", "/dev/urandom", "/dev/console"],
        "metadata_dirs": ["/metadata", "/home/metadata"],
    },
    macros={
        "container": "container.id != host",
        "outbound": "evt.type in (connect, sendto, sendmsg)",
        "inbound": "evt.type in (accept, accept4, recvfrom, recvmsg)",
        "open_write": "evt.type in (open, openat, creat) and evt.is_open_write = true",
        "open_read": "evt.type in (open, openat) and evt.is_open_read = true",
        "spawned": "evt.type in (execve, execveat)",
        "dns_query": "evt.type = recvfrom and fd.sport = 53",
        "allowed_target": "fd.sip in (local_networks) or fd.sip.name in (registries)",
        "below_etc": "fd.name startswith /etc/",
        "below_root": "fd.directory = / or fd.name startswith /root/",
        "cron_file": "fd.name startswith /etc/cron or fd.name startswith /var/spool/cron",
        "ssh_file": "fd.name contains /.ssh/",
        "hidden": "fd.filename startswith .",
        "shell_file": "fd.filename in (shell_files)",
        "modify": "evt.type in (rename, renameat, unlink, unlinkat, rmdir)",
        "make_dir": "evt.type in (mkdir, mkdirat)",
        "network_call": "outbound or inbound",
        "in_binary_dir": "fd.directory in (binary_dirs)",
        "modify_binary_dirs": "modify and in_binary_dir",
        "mkdir_binary_dirs": "make_dir and in_binary_dir",
        "modify_metadata": "modify and fd.name pmatch (metadata_dirs)",
        "create_below_dev": "(open_write or evt.type = creat) and fd.directory = /dev and not fd.name in (devices)",
        "ssh_connection": "outbound and fd.sport = 22 and not allowed_target",
        "system_process_network": "network_call and proc.name in (system_processes) and not fd.sip in (local_networks)",
        "unexpected_udp": "outbound and fd.l4proto = udp and not fd.sport in (usual_ports) and not allowed_target",
        "untrusted_shell": "spawned and proc.name in (shells) and proc.pname in (servers)",
        "database_child": "spawned and proc.pname in (databases)",
        "interactive_system_user": "spawned and user.name in (system_users) and proc.name in (shells)",
        "key_search": "spawned and proc.name in (search_tools) and (proc.cmdline icontains 'BEGIN RSA PRIVATE' or proc.cmdline contains id_rsa or proc.cmdline contains id_dsa or proc.cmdline icontains password)",
        "remote_code": "spawned and proc.name in (nc, ncat) and (proc.cmdline contains ' -e' or proc.cmdline contains ' -c')",
        "unexpected_user": "spawned and user.name exists and not user.name in (usual_users) and not user.name in (system_users)",
        "crontab_call": "spawned and proc.name = crontab",
        "plain_setuid": "evt.type in (setuid, setgid, setresuid) and not proc.name in (sudo, su) and not proc.pname in (sudo, su)",
    },
    rules={
        "outgoing_domain": "container and dns_query",
        "outgoing_ip": "container and (outbound and not allowed_target or ssh_connection or system_process_network and outbound or unexpected_udp)",
        "incoming_ip": "container and inbound and not fd.cip in (local_networks) and not dns_query",
        "write_file": "container and (open_write and (in_binary_dir or below_etc or below_root or cron_file) or modify_binary_dirs or mkdir_binary_dirs or create_below_dev or modify_metadata)",
        "read_file": "container and open_read and (ssh_file or fd.name in (secret_files))",
        "spawn_process": "container and (open_write and shell_file or spawned and (proc.name in (network_tools) or proc.name in (copy_tools)) or database_child or untrusted_shell or interactive_system_user or key_search or remote_code or crontab_call or unexpected_user)",
        "sensitive_operation": "container and (plain_setuid or evt.type in (symlink, symlinkat) and fd.name in (secret_files))",
    },
)
