r"""Grok patterns of monitoring, mail, sensor and delivery services: lines of columns, built from the columns' names.

Names of patterns and captures, record types, and the order of columns are fixed values of the producers'
documentation. A column is whatever stands before the next mark, taken possessively, so a line of any length and any
number of columns is read once.
"""

from __future__ import annotations

import re

COLUMNS = {"TABFIELD": r"[^\t]*+", "SEMICOLONFIELD": "[^;]*+"}


def _columns(names: str, field: str, mark: str) -> str:
    return mark.join(f"%{{{field}:{n}}}" for n in names.split())


def _nagios() -> dict[str, str]:
    """Records "[epoch] TYPE: a;b;c", and external commands, whose first column names them."""
    subjects = {"SERVICE": "hostname service", "HOST": "hostname"}
    records: dict[str, tuple[str, str]] = {"TIMEPERIOD_TRANSITION": ("TIMEPERIOD TRANSITION", "service unknown1 unknown2")}
    for subject, own in subjects.items():
        kinds = (
            (f"CURRENT_{subject}_STATE", f"CURRENT {subject} STATE", f"{own} state statetype statecode message"),
            (f"{subject}_NOTIFICATION", "", f"notifyname {own} state contact message"),
            (f"{subject}_ALERT", "", f"{own} state statelevel attempt message"),
            (f"{subject}_FLAPPING_ALERT", "", f"{own} state message"),
            (f"{subject}_DOWNTIME_ALERT", "", f"{own} state comment"),
            (f"PASSIVE_{subject}_CHECK", "", f"{own} state comment"),
            (f"{subject}_EVENT_HANDLER", "", f"{own} state statelevel event_handler_name"),
        )
        records |= {name: (text or name.replace("_", " "), columns) for name, text, columns in kinds}
    commands = {f"{verb}_{what}": own for verb in ("DISABLE", "ENABLE") for what, own in (
        ("SVC_CHECK", "hostname service"), ("HOST_CHECK", "hostname"), ("HOST_SVC_NOTIFICATIONS", "hostname"),
        ("HOST_NOTIFICATIONS", "hostname"), ("SVC_NOTIFICATIONS", "hostname service"))}
    commands |= {f"PROCESS_{s}_CHECK_RESULT": f"{own} state check_result" for s, own in subjects.items()}
    downtime = "start_time end_time fixed trigger_id duration"
    commands |= {"SCHEDULE_HOST_DOWNTIME": f"hostname {downtime}", "SCHEDULE_SERVICE_DOWNTIME": f"hostname service {downtime}"}

    named = lambda columns: _columns(" ".join(f"nagios_{c}" for c in columns.split()), "SEMICOLONFIELD", ";")
    out = {"NAGIOS_TYPE_EXTERNAL_COMMAND": "EXTERNAL COMMAND", "NAGIOS_WARNING": "Warning:%{SPACE}%{GREEDYDATA:nagios_message}"}
    for name, (text, columns) in records.items():
        last = columns.split()[-1]  # free text, which may have the mark
        body = named(" ".join(columns.split()[:-1]))
        out |= {f"NAGIOS_TYPE_{name}": text, f"NAGIOS_{name}": f"%{{NAGIOS_TYPE_{name}:nagios_type}}: {body};%{{GREEDYDATA:nagios_{last}}}"}
    lines = ["NAGIOS_WARNING", *(f"NAGIOS_{name}" for name in records)]
    for name, columns in commands.items():
        out[f"NAGIOS_EC_{name}"] = name
        tail = ";%{SEMICOLONFIELD:author};%{GREEDYDATA:comment}" if "DOWNTIME" in name else ""
        out[f"NAGIOS_EC_LINE_{name}"] = f"%{{NAGIOS_TYPE_EXTERNAL_COMMAND:nagios_type}}: %{{NAGIOS_EC_{name}:nagios_command}};{named(columns)}{tail}"
        lines.append(f"NAGIOS_EC_LINE_{name}")
    return out | {"NAGIOSLOGLINE": f"%{{NAGIOSTIME}} (?:{'|'.join(f'%{{{x}}}' for x in lines)})"}


#: Columns of a connection, with which the sensor's records begin.
_FLOW = "ts uid orig_h orig_p resp_h resp_p"
SENSOR = {
    name: _columns(columns, "TABFIELD", r"\t")
    for name, columns in {
        "BRO_HTTP": f"{_FLOW} trans_depth method domain uri referrer user_agent request_body_len response_body_len status_code status_msg info_code info_msg filename bro_tags username password proxied orig_fuids orig_mime_types resp_fuids resp_mime_types",
        "BRO_DNS": f"{_FLOW} proto trans_id query qclass qclass_name qtype qtype_name rcode rcode_name AA TC RD RA Z answers TTLs rejected",
        "BRO_CONN": f"{_FLOW} proto service duration orig_bytes resp_bytes conn_state local_orig missed_bytes history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes tunnel_parents",
        "BRO_FILES": "ts fuid tx_hosts rx_hosts conn_uids source depth analyzers mime_type filename duration local_orig is_orig seen_bytes total_bytes missing_bytes overflow_bytes timedout parent_fuid md5 sha1 sha256 extracted",
    }.items()
}

_EDGE = "x_edge_location sc_bytes:int clientip cs_method cs_host cs_uri_stem sc_status:int referrer agent cs_uri_query cookies x_edge_result_type x_edge_request_id x_host_header cs_protocol cs_bytes:int time_taken:float x_forwarded_for ssl_protocol ssl_cipher x_edge_response_result_type"
DELIVERY = {"CLOUDFRONT_ACCESS_LOG": r"(?<timestamp>%{YEAR}-%{MONTHNUM}-%{MONTHDAY}\t%{TIME})\t" + _columns(_EDGE, "TABFIELD", r"\t")}

_FIELDS = ("REMOTE_HOST", "INTERFACE", "PROTOCOL", "MSG_SIZE", "HEADER_ID", "SUBJECT", "UNKNOWN_FIELD")
MAIL = {
    "EXIM_MSGID": "[0-9A-Za-z]{6}-[0-9A-Za-z]{6}-[0-9A-Za-z]{2}", "EXIM_FLAGS": r"<=|=>|->|>>|\*>|\*\*|==",
    "EXIM_DATE": "%{YEAR:exim_year}-%{MONTHNUM:exim_month}-%{MONTHDAY:exim_day} %{TIME:exim_time}", "EXIM_PID": r"\[%{POSINT:pid}\]",
    "EXIM_QT": "".join(rf"(?:\d+{unit})?" for unit in "ywdhms"),
    "EXIM_EXCLUDE_TERMS": "Message is frozen|(?:Start|End) queue run|Warning:|retry time not reached|no (?:IP address found for host|immediate delivery)|unexpected disconnection while reading SMTP command|another process is handling this message",
    "EXIM_REMOTE_HOST": r"H=(?:%{HOSTNAME:remote_hostname} )?(?:\((?<remote_heloname>[^)\s]*)\) )?\[%{IP:remote_host}\](?::%{POSINT:remote_port})?",
    "EXIM_INTERFACE": r"I=\[%{IP:exim_interface}\](?::%{POSINT:exim_interface_port})?", "EXIM_PROTOCOL": "P=%{NOTSPACE:protocol}", "EXIM_MSG_SIZE": "S=%{NONNEGINT:exim_msg_size}",
    "EXIM_HEADER_ID": "id=%{NOTSPACE:exim_header_id}", "EXIM_SUBJECT": "T=%{QS:exim_subject}", "EXIM_UNKNOWN_FIELD": "[0-9A-Za-z]{1,4}=%{NOTSPACE}",
    "EXIM_NAMED_FIELDS": f"(?: (?:{'|'.join(f'%{{EXIM_{f}}}' for f in _FIELDS)}))*+",
    "EXIM_MESSAGE_ARRIVAL": "%{EXIM_DATE:timestamp} (?:%{EXIM_PID} )?%{EXIM_MSGID:exim_msgid} <= (?:<>|%{NOTSPACE:exim_sender_email})%{EXIM_NAMED_FIELDS}(?: for %{EMAILADDRESS:exim_recipient_email})?",
    "EXIM": "%{EXIM_MESSAGE_ARRIVAL}",
}

WORKERS = {
    "MCOLLECTIVE": r"[DIWEFA], \[%{TIMESTAMP_ISO8601:timestamp} #%{POSINT:pid}\] +%{LOGLEVEL:event_level}", "MCOLLECTIVEAUDIT": "%{TIMESTAMP_ISO8601:timestamp}:",
    "RCONTROLLER": r"(?<controller>[\w:]+)#(?<action>\w+)",
    "RAILS3HEAD": 'Started %{WORD:verb} "%{URIPATHPARAM:request}" for %{IPORHOST:clientip} at (?<timestamp>%{YEAR}-%{MONTHNUM}-%{MONTHDAY} %{TIME} %{ISO8601_TIMEZONE})',
    "RPROCESSING": r"\s*Processing by %{RCONTROLLER} as (?<format>\S+)(?:\s+Parameters: \{(?<params>[^\n]*)\})?",
    "RAILS3PROFILE": r"\((?:Views: %{NUMBER:viewms}ms(?: \| )?)?(?:ActiveRecord: %{NUMBER:activerecordms}ms)?[^)\n]*\)",
    "RAILS3FOOT": r"Completed %{POSINT:response}[^\n]*? in %{NUMBER:totalms}ms(?: %{RAILS3PROFILE})?",
    "RAILS3": r"%{RAILS3HEAD}(?:%{RPROCESSING})?(?<context>(?s:.*?))(?:%{RAILS3FOOT}|\z)",
}

#: Netfilter's KEY=value lines, whose marks stand in this order.
_NETFILTER = r"(?:IN=%{USERNAME:nf_in_interface})?.*?(?:OUT=%{USERNAME:nf_out_interface})?.*?(?:MAC=%{COMMONMAC:nf_dst_mac}:%{COMMONMAC:nf_src_mac})?.*?SRC=%{IP:nf_src_ip} DST=%{IP:nf_dst_ip}.*?PROTO=%{WORD:nf_protocol}(?:.*?SPT=%{INT:nf_src_port} DPT=%{INT:nf_dst_port})?"


def _side(side: str) -> str:
    return rf"%{{DATA:err_{side}_interface}}:%{{IP:err_{side}_ip}}(?:\(%{{DATA:err_{side}_fwuser}}\))?"


def _packet(side: str) -> str:
    return rf"{side} %{{IP:orig_{side}_ip}}/%{{INT:orig_{side}_port}}(?:\(%{{DATA:orig_{side}_fwuser}}\))?"


FILTERS = {
    "SFW2": rf"(?:%{{SYSLOGTIMESTAMP:timestamp}}|%{{TIMESTAMP_ISO8601:timestamp}}) .*?SFW2-IN[A-Za-z]*-%{{NOTSPACE:nf_action}} {_NETFILTER}",
    "CISCOFW313005": "%{CISCO_REASON:reason} for %{WORD:protocol} error message: %{WORD:err_protocol} src " + _side("src") + " dst " + _side("dst") + r" \(type %{INT:err_icmp_type}, code %{INT:err_icmp_code}\) on %{DATA:interface} interface\.\s+Original IP payload: %{WORD:protocol} " + _packet("src") + " " + _packet("dst"),
}

#: The backup server's messages: fixed texts of the program, with places in angle brackets.
_MESSAGES = {
    "MAX_CAPACITY": 'User defined maximum volume capacity <size> exceeded on device "<device>" (<path>)',
    "END_VOLUME": 'End of medium on Volume "<volume>" Bytes=<size> Blocks=<size> at <when>.',
    "NEW_VOLUME": 'Created new Volume "<volume>" in catalog.',
    "NEW_LABEL": 'Labeled new Volume "<volume>" on device "<device>" (<path>).',
    "WROTE_LABEL": 'Wrote label to prelabeled Volume "<volume>" on device "<device>" (<path>)',
    "NEW_MOUNT": 'New volume "<volume>" mounted on device "<device>" (<path>) at <when>.',
    "NOOPEN": "Cannot open <text>: ERR=<berror>",
    "NOOPENDIR": "Could not open directory <text>: ERR=<berror>",
    "NOSTAT": "Could not stat <text>: ERR=<berror>",
    "NOJOBS": 'There are no more Jobs associated with Volume "<volume>". Marking it purged.',
    "ALL_RECORDS_PRUNED": 'All records pruned from Volume "<volume>"; marking it "Purged"',
    "BEGIN_PRUNE_JOBS": "Begin pruning Jobs older than <number> month <number> days .",
    "BEGIN_PRUNE_FILES": "Begin pruning Files.",
    "PRUNED_JOBS": "Pruned <number> Job<s> for client <client> from catalog.",
    "PRUNED_FILES": "Pruned Files from <number> Job<s> for client <client> from catalog.",
    "ENDPRUNE": "End auto prune.",
    "STARTJOB": "Start Backup JobId <number>, Job=<job>",
    "STARTRESTORE": "Start Restore Job <job>",
    "USEDEVICE": 'Using Device "<device>"',
    "DIFF_FS": "<path> is a different filesystem. Will not descend from <path> into it.",
    "JOBEND": "Job write elapsed time = <elapsed>, Transfer rate = <rate> Bytes/second",
    "NOPRUNE_JOBS": "No Jobs found to prune.",
    "NOPRUNE_FILES": "No Files found to prune.",
    "VOLUME_PREVWRITTEN": 'Volume "<volume>" previously written, moving to end of data.',
    "READYAPPEND": 'Ready to append to end of Volume "<volume>" size=<size>',
    "CANCELLING": "Cancelling duplicate JobId=<number>.",
    "MARKCANCEL": "JobId <number>, Job <job> marked to be canceled.",
    "CLIENT_RBJ": 'shell command: run ClientRunBeforeJob "<runjob>"',
    "VSS": "<writer>VSS <writer>",
    "MAXSTART": "Fatal error: Job canceled because max start delay time exceeded.",
    "DUPLICATE": "Fatal error: JobId <duplicate> already running. Duplicate job not allowed.",
    "NOJOBSTAT": "Fatal error: No Job status returned from FD.",
    "FATAL_CONN": "Fatal error: <code> Unable to connect to <peer>. ERR=<berror>",
    "NO_CONNECT": "Warning: <code> Could not connect to <peer>. ERR=<berror>",
    "NO_AUTH": "Fatal error: Unable to authenticate with File daemon at <text>. Possible causes:",
    "NOSUIT": "No prior or suitable Full backup found in catalog. Doing FULL backup.",
    "NOPRIOR": "No prior Full backup Job record found.",
    "JOB": "<error>Bacula <host> <version> (<version>):",
}


def _backup() -> dict[str, str]:
    """Messages as patterns: their words literally, one blank or more between them, and a pattern at each place."""
    word = "%{USER}"
    places = {
        "size": r"\d{1,3}(?:,?\d{3}){0,6}", "number": "%{INT}", "s": "s?", "text": "%{DATA}", "path": "%{UNIXPATH}", "when": r"%{MONTHDAY}-%{MONTH}-%{YEAR} %{HOUR}:%{MINUTE}",
        "rate": "%{NUMBER} [KMG]?", "writer": r"(?:Generate |Writer)?", "code": r"[\w.]+:\d+", "peer": "(?:Client: %{BACULA_HOST:client}|Storage daemon) on %{HOSTNAME}:%{POSINT}",
        "error": "(?:Error: )?", "host": "%{BACULA_HOST}", "version": "%{BACULA_VERSION}", "berror": "%{GREEDYDATA:berror}", "runjob": "%{GREEDYDATA:runjob}", "elapsed": "%{DATA:elapsed}", "duplicate": "%{INT:duplicate}",
        **{n: f"%{{BACULA_{kind}:{n}}}" for n, kind in (("device", "DEVICE"), ("volume", "VOLUME"), ("client", "HOST"), ("job", "JOB"))},
    }
    out = {f"BACULA_{n}": word for n in ("VOLUME", "DEVICE", "VERSION", "JOB")}
    out |= {"BACULA_TIMESTAMP": "%{MONTHDAY}-%{MONTH} %{HOUR}:%{MINUTE}", "BACULA_HOST": r"[0-9A-Za-z-]+", "BACULA_DEVICEPATH": "%{UNIXPATH}", "BACULA_CAPACITY": places["size"]}
    for name, text in _MESSAGES.items():
        parts = re.split(r"<(\w+)>", text)
        out[f"BACULA_LOG_{name}"] = "".join(places[x] if k % 2 else re.escape(x).replace(r"\ ", " +") for k, x in enumerate(parts))
    every = "|".join(f"%{{BACULA_LOG_{name}}}" for name in _MESSAGES)
    return out | {"BACULA_LOGLINE": rf"%{{BACULA_TIMESTAMP:bts}} %{{BACULA_HOST:hostname}}(?: JobId %{{INT:jobid}})?:? +(?:{every})"}


SERVICES: dict[str, str] = {**COLUMNS, **_backup(), **_nagios(), **SENSOR, **DELIVERY, **MAIL, **WORKERS, **FILTERS}
